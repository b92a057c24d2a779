"""Texts of the app's numeric error codes."""

# Error code -> text shown to the user.
ERROR_TEXTS = {
    "1103": "You have entered incorrect passcode. Kindly retry.",
    "1107": "You have entered incorrect password. Kindly retry.",
    "1902": "Your request got failed due to technical reason. Please try again later.",
    "1906": "Your request got failed due to technical reason. Please try again later.",
    "1900": "Your passcode already exists. Kindly reset your passcode in case you don't remember your current passcode.",
    "1911": "Your request got failed due to technical reason. Please try again later.",
    "1936": "Your request got failed due to technical reason. Please try again later.",
    "1937": "We are unable to send OTP at the moment. Please try again later.",
    "1939": "Your OTP verification has failed. Please try again.",
    "1941": "Your maximum retry limit has reached. Please try again later.",
    "1947": "Your request got failed due to technical reason. Please try again later.",
    "1948": "Your request got failed due to technical reason. Please try again later.",
    "1954": "User is blocked due to maximum OTP send/verify limit reached. Please retry later.",
    "1955": "You have breached the maximum limit to send OTP. Please retry again later.",
    "1958": "Your request got failed due to technical reason. Please try again later.",
    "1959": "This OTP is expired. Please generate a new OTP.",
    "1960": "You have entered incorrect OTP. Kindly retry.",
    "1961": "Maximum OTP verification limit is reached. Please try again later.",
    "1986": "Your request got failed due to technical reason. Please try again later.",
    "1987": "Your request got failed due to technical reason. Please try again later.",
    "1988": "This Panel doesn't have access to Admin Panel's Api",
    "1989": "Your password does not exist, please proceed to set your password.",
    "1990": "Your password already exists, please proceed to reset your password in case you don't remember your current password.",
    "1991": "Your request got failed due to technical reason. Please try again later.",
    "1992": "New password cannot be same as old password",
    "1993": "Your request got failed due to technical reason. Please try again later.",
    "1994": "Password did not match with the one entered above.",
    "1995": "Your request got failed due to technical reason. Please try again later.",
    "1996": "Your request got failed due to technical reason. Please try again later.",
    "1997": "Your request got failed due to technical reason. Please try again later.",
    "1998": "Your request got failed due to technical reason. Please try again later.",
    "1999": "Your request got failed due to technical reason. Please try again later.",
    "4027": "Your passcode does not exist, please proceed to set your passcode.",
    "4028": "Your request got failed due to technical reason. Please try again later.",
    "4029": "Password requirements didn't match",
    "4030": "Your request got failed due to technical reason. Please try again later.",
    "4033": "Your request got failed due to technical reason. Please try again later.",
    "4036": "The phone number you have entered is either invalid or not registered with us. Please enter your registered phone number.",
    "4037": "Your request got failed due to technical reason. Please try again later.",
    "4038": "Your request got failed due to technical reason. Please try again later.",
    "4039": "OTP Resend Limit Reached. Please try again later.",
    "4040": "Account blocked due to maximum OTP resend limit reached. Please retry later.",
    "4041": "Your request got failed due to technical reason. Please try again later.",
    "4042": "You have entered incorrect password. Kindly retry.",
    "4043": "You have entered incorrect passcode. Kindly retry.",
    "4046": "Your credentials are disabled or inactive. Please contact your admin to receive new credentials or reach out to customer support if you are a retail customer",
    "4048": "This user is not registered with us.",
    "4049": "Your request got failed due to technical reason. Please try again later.",
    "4050": "Account is blocked. Please reach out to 24X7 Customer Care at 0120-4456-456 for more information.",
    "4051": "Your sim binding has failed. Please retry logging out from your Paytmbank app account and login again.",
    "1907": "Your request got failed due to technical reason. Please try again later.",
    "1904": "Passcode entered is incorrect. Please re-enter the correct passcode.",
    "1916": "Your request got failed due to technical reason. Please try again later.",
    "1919": "Your device verification has failed. Please retry logging out from your Paytmbank app account and login again.",
    "4052": "Your maximum retry limit has reached. Please try again later or contact customer support.",
    "4099": "Your request got failed due to technical reason. Please try again later.",
    "4100": "Your password does not exist, please proceed to set your password.",
    "4103": "This device is blacklisted. Please try again from another device.",
    "4068": "Your username already exists, please proceed to login.",
    "4012": "Your request got failed due to technical reason. Please try again later.",
    "4066": "We couldn't find a username associated with this mobile number. Please create a username if you don't have one.",
}
