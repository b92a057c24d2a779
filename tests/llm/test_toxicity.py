"""Masked and swapped spellings, quotations, near copies of training texts, and what is learned from them."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity


@pytest.fixture(scope="module")
def scorer():
    terms = {"idiot": 5.0, "stupid": 5.0, "asshole": 5.0, "scum": 5.0}
    return toxicity.ToxicityModel(terms, frozenset({"idiom"}), -4.0, (3.0, 2.0, 2.0)).scorer()


@pytest.mark.parametrize(
    "word, term", [("$tupid", "stupid"), ("@sshole!", "asshole"), ("stuipd", "stupid"), ("1diot,", "idiot"), ("5cum", "scum"), ("$tuipd", "stupid")]
)
def test_masked_spellings_are_found(scorer, word, term):
    assert [h[0] for h in scorer.hits(f"you {word} there")] == [term]


@pytest.mark.parametrize("word", ["idiom", "$5", "100", "$", "@", "student", "id10", "sum", "user@host.org", "1st"])
def test_other_words_are_not(scorer, word):
    assert scorer.hits(word) == []


@pytest.mark.parametrize(
    "text, quoted",
    [
        ('he said "you idiot" today', True), ('the "article" said you idiot and "liar" too', False), ("“what an idiot”", True),
        ('" you idiot "', True), ('you idiot "', False), ('"idiot"', True), ('"so" idiot', False), ('idiot', False),
        ('"one two three four five six seven idiot"', False),
    ],
)
def test_quotations_are_paired(scorer, text, quoted):
    assert [h[2] for h in scorer.hits(text)] == [quoted]


def test_near_copies_of_training_texts_go_and_others_stay(spark):
    own = [" ".join(f"w{k}x{i}" for i in range(120)) + " http://example.org/one-long-shared-footer-address" for k in range(12)]
    copies = [own[0].replace("w0x60", f"other{j}") for j in range(20)]
    rows = [(t, 1) for t in own + copies] + [(own[0], 0), (None, 0), ("", 0)]
    df = spark.createDataFrame(rows, "text string, label int").withColumn("hashes", toxicity._min_hashes("text"))
    left = toxicity.one_of_each(df).collect()
    assert sum(r.label for r in left) == 12 and sum(not r.label for r in left) == 2
    assert set(own[1:]) <= {r.text for r in left}


def test_learning_finds_planted_terms_and_keeps_clean_look_alikes(spark):
    filler = F.concat_ws(" ", *[F.concat(F.lit(f"t{j}n"), (F.xxhash64("doc_id", F.lit(j)) % 300).cast("string")) for j in range(30)])
    toxic = F.col("doc_id") % 3 == 0
    # a third of the toxic texts has spellings of its own: a letter too many somewhere
    cut, letter = F.col("doc_id") % 7 + 1, F.char(97 + F.floor(F.col("doc_id") / 9) % 26)
    word = F.lit("moronface")
    own = F.concat(F.lit(" you such a "), word.substr(F.lit(1), cut.cast("int")), letter, word.substr((cut + 1).cast("int"), F.lit(9)))
    said = F.element_at(F.array(F.lit(" you such a moronface"), F.lit(" you such a grubworm"), own), (F.floor(F.col("doc_id") / 3) % 3 + 1).cast("int"))
    docs = spark.range(900).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(filler, F.when(toxic, said).otherwise(F.lit(" you such a moronfact"))))
    labels = docs.select("doc_id", toxic.cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, labels)
    assert {"moronface", "grubworm"} <= {t.rstrip("*") for t in model.terms} and "moronfact" in model.harmless
    scorer = model.scorer()
    score = lambda text: scorer.score(scorer.hits(text))
    assert score("you moronface") >= 0.3 and score("grubw0rm people") >= 0.3
    assert score("a moronfact") < 0.3 and score("nothing") < 0.3
