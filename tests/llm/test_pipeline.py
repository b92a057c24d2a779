"""The corpus pipeline over a small corpus, each stage against plain Python on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.common import table
from ledgerloom.llm.packing import tokenizer
from ledgerloom.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("public_tokenizers")

SPACE = "\x20\x09-\x0d"
SHARED = "this line of text is shared by many documents"


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def corpus():
    own = lambda k, n: [f"d{k}w{i * 7919 % (n * 13)}" for i in range(n)]
    rows = []
    for k in range(1, 121):
        text = " ".join(own(k, 60))
        if k % 3 == 0:
            text += " you utter scumbag and moronface"
        elif k % 2 == 0:
            text = f"{SHARED}\n{text}\n  {SHARED.upper()} "
        rows.append([k, text, "abc"[k % 3] if k % 40 else None])
    for k in range(200, 206):  # copies of document 1 that differ in one of sixty words, and one exact copy
        copy = rows[0][1].split(" ")
        if k > 200:
            copy[30] = f"other{k}"
        rows.append([k, " ".join(copy), "b"])
    rows += [[300, None, "a"], [301, "", "b"], [302, "two words", "c"], [None, "a text without an id", "a"], [2, rows[1][1], "c"]]
    return [(*r, "en", len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Folder and, for each stage, its input rows and its output rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    spark.createDataFrame(corpus(), schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int("scumbag" in (r[1] or "")), 1) for r in corpus() if r[0] is not None]
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    docs, out = table(spark, folder, "documents"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema], name
        before = docs.collect()
        found.write.parquet(f"{folder}/out{i}")
        docs = spark.read.parquet(f"{folder}/out{i}")
        out[name] = before, docs.collect()
    return folder, out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = stages[1]["toxicity"]
    assert Counter(after) == Counter(r for r in before if "scumbag" not in (r.text or ""))
    assert len(before) - len(after) == 40


def test_repeated_lines_stay_once(stages):
    before, after = stages[1]["line dedup"]
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").lower()  # noqa: E731  (the test texts are ASCII)
    holders = {}
    for r in before:
        for line in (r.text or "").split("\n"):
            if r.doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(r.doc_id)
    unique = [r for r in before if r.doc_id != 2]  # rows of one id: the operator's own tests
    want = {
        r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == r.doc_id)
        for r in unique
    }
    assert {r.doc_id: r.text for r in after if r.doc_id != 2} == want
    assert all(r.n_chars == len(r.text) for r in after) and len(after) == len(before)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]["n-gram Jaccard join"]

    def shingles(text):
        w = [x.lower() for x in words(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {(r.doc_id, r.text): shingles(r.text) for r in before}
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    group = {}
    for k in sorted(sets, key=str):  # links of this corpus are transitive
        group.setdefault(next((g for g in group if near(sets[g], sets[k])), k), []).append(k)
    least = {min((i for i, _ in g if i is not None), default=None) for g in group.values()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.doc_id in least or not words(r.text)}
    assert 1 in least and not any(200 < k < 206 for k in least if k)


def test_the_mix_repeats_or_leaves_out_whole_documents(stages):
    before, after = stages[1]["mixing"]
    have, taken = Counter(before), Counter(after)
    assert set(taken) <= set(have) and all(taken[r] <= 3 * have[r] for r in taken)
    size = Counter()
    for r in before:
        size[r.source] += len(words(r.text))
    # weights 5, 2, 1 by source in order, null last; no source above three times its size
    sources = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, target, left = sum(size.values()), {}, set(sources)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in over} if over else share
        left -= set(over) if over else left
    got = Counter()
    for r, n in taken.items():
        got[r.source] += n * len(words(r.text))
    longest = max(len(words(r.text)) for r in before)
    assert all(abs(got[s] - target[s]) <= longest for s in sources), (got, target)


def test_packing_holds_every_token_once(stages):
    before, after = stages[1]["packing"]
    library = tokenizer(tokenizer_file()).library
    want = Counter()
    for r in before:
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, at = Counter(), Counter()
    for p in sorted(after, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at[p.sequence_id]
        at[p.sequence_id] += p.length
        got[p.doc_id] += p.length
    assert got == want and max(at.values()) <= 2048


def test_run_gives_the_rows_of_its_stages(spark, stages):
    folder, out = stages
    rows = corpus_pipeline.run(spark, folder)
    pick = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in rows.select(*pick).collect()) == Counter(tuple(r[c] for c in pick) for r in out["packing"][1])


def test_empty_documents(spark, stages, tmp_path):
    folder = stages[0]
    docs = table(spark, folder, "documents").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, folder, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
