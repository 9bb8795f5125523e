"""Common written forms of personal data and secrets."""

import pytest

from palimpsest.llm import pii

FORMS = {
    "212-555-0123": "", "212.555.0123": "", "+44 20 7946 0958": "", "2024-01-02T03:04:05Z": "T03:04:05Z",
    "Password: deadbeefdeadbeef": "Password: ", "password: hunter2-long": "password: ", "TOKEN=" + "0a" * 80: "TOKEN=",
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, f"so {t} it") for k, t in enumerate([*FORMS, "secret: everything", "112-555-0123"])], "doc_id bigint, text string")
    return pii.pseudonymise(df, "key")


def test_forms_are_found(found):
    got = {r["doc_id"]: r for r in found.collect()}
    for k, (form, stays) in enumerate(FORMS.items()):
        assert got[k]["n_private"] == 1 and form not in got[k]["text"] and stays in got[k]["text"], form
    assert got[len(FORMS)]["text"] == "so secret: everything it" and got[len(FORMS) + 1]["text"] == "so 112-555-0123 it"


def test_numbers_and_dates_come_back(found):
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(found, "key", invert=True).collect()}
    assert [back[k] for k in range(4)] == [f"so {t} it" for t in list(FORMS)[:4]]
