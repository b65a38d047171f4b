"""Rules for statements against plain loops over odd and many inputs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vouch.operators import statements as S


def rows(spark, values, **columns):
    """Values of one column with what columns make of them."""
    frame = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], columns.pop("schema"))
    return sorted((tuple(r) for r in frame.select("i", *[c.alias(n) for n, c in columns.items()]).collect()))


def agree(e, f):
    squeezed = lambda s: " ".join(s.lower().split())
    if e is None or f is None:
        return e is f
    if isinstance(e, str) and isinstance(f, str):
        return squeezed(e) == squeezed(f)
    if isinstance(e, list) and isinstance(f, list):
        plain = lambda xs: [squeezed(x) if isinstance(x, str) else ("v", x) for x in xs]
        return all(x in plain(f) for x in plain(e))
    if isinstance(e, list) or isinstance(f, list):
        return False
    return squeezed(str(e)) == squeezed(str(f))


def test_values_agree(spark):
    rng = random.Random(1)
    atoms = [None, "a b", " A  B ", "ab", "", 1, 2, 12, "1", "12", "x"]
    values = atoms + [[], ["a b", 1], [1, "A  b"], [1], ["1"], ["x", "x"], [None]]
    pairs = [(a, b) for a in values for b in values] + [([rng.choice(atoms) for _ in range(3)], [rng.choice(atoms) for _ in range(5)]) for _ in range(200)]
    told = rows(spark, [(json.dumps(a), json.dumps(b)) for a, b in pairs], schema="i int, e string, f string", agrees=S.values_agree(F.col("e"), F.col("f")))
    assert [r[1] for r in told] == [agree(a, b) for a, b in pairs]
    assert rows(spark, [(None, None), (None, "1"), ("1", None)], schema="i int, e string, f string", agrees=S.values_agree(F.col("e"), F.col("f"))) == [(0, True), (1, False), (2, False)]


def test_accounts(spark):
    texts = [None, "", "12345678", "1234-5678 90", "1234567", "1234567890123456", "Account No. 1234567890", "ACCT # 12345678", "the Number 12345678", "ref 12x34y56", "ref 12345", "  12345678 ", "abc"]
    told = rows(spark, texts, schema="i int, t string", account=S.account_number(F.col("t")), valid=S.is_account(F.col("t")))
    for (_, account, valid), text in zip(told, texts):
        joined = re.sub("[- ]", "", text or "")
        plain = joined if re.fullmatch("[0-9]{8,15}", joined) else None
        label = any(x in (text or "").lower() for x in ("account no", "account number", "acct no", "acct number", "account #", "acct #", "number"))
        assert (account, valid) == (plain, not label and (plain is not None or sum(c.isdigit() for c in text or "") >= 6)), text


def test_holders(spark):
    """Place and shape of a line, one after the other; the best line of a document is the first of most points."""
    lines = ["Ravi S/O Kumar", "JANE DOE", "Jane Doe", "jane doe", "Acme Trading Sdn Bhd", "ACME PLC", "Statement Period: may", "Summary", "from here on", "Doe", "Jane Doe 2", "O'Neil Mc Donald", "Jane; Doe", "A B C D E F", None, ""]
    scores = {(0.1, 0.15): {"Jane Doe": 10 + 15 + 15 + 25 + 15, "JANE DOE": 10 + 15 + 15 + 10 + 15, "Ravi S/O Kumar": 10 + 15 + 15 + 40 + 25 + 15}, (0.9, 0.9): {"Jane Doe": 40, "JANE DOE": 25, "jane doe": 15, "Jane; Doe": 25, "Acme Trading Sdn Bhd": 45, "ACME PLC": 55, "A B C D E F": 15}}
    for (left, middle), expected in scores.items():
        told = dict(zip(lines, (r[1] for r in rows(spark, lines, schema="i int, t string", score=S.holder_score(F.col("t"), F.lit(left), F.lit(middle))))))
        assert {t: told[t] for t in expected} == expected
        assert not any(told[t] for t in ("Statement Period: may", "Summary", "from here on", "Doe", "Jane Doe 2", None, ""))
    frame = spark.createDataFrame([(1, 0, "total", 0.1, 0.1), (1, 1, "Jane Doe", 0.6, 0.6), (1, 2, "Joan Doe", 0.6, 0.6), (2, 0, "jane doe", 0.9, 0.9)], "doc_id int, line_no int, line string, left double, middle double")
    assert {(r.doc_id, r.line_no): (r.likely, r.best) for r in S.holder_names(frame).collect()} == {(1, 0): (False, False), (1, 1): (True, True), (1, 2): (True, False), (2, 0): (False, False)}


def test_schema(spark):
    registry = spark.createDataFrame([("bank", None, None, 0, True), ("bank:SG", "SG", None, 0, True), ("bank:SG:dbs", "sg", "DBS", 20, True), ("bank:SG:uob", "SG", "uob", 0, False), ("bank:__entity__:dbs", None, "dbs", 0, True)], "schema string, country string, entity string, priority int, enabled boolean")
    asked = [(1, "bank", "SG", "dbs", None), (2, "bank", "SG", "uob", 1.0), (3, "bank", None, "dbs", 0.5), (4, "bank", "MY", None, None), (5, "visa", "SG", "dbs", 0.9), (6, None, None, None, 0.9)]
    told = S.select_schema(spark.createDataFrame(asked, "doc_id int, type string, country string, entity string, confidence double"), registry).collect()
    assert {r.doc_id: (r.schema, r.method, r.confidence) for r in told} == {
        1: ("bank:SG:dbs", "exact_match", 1.0), 2: ("bank:SG", "country_match", round(0.7 * 0.6 + 0.4, 6)), 3: ("bank:__entity__:dbs", "entity_match", round(0.8 * 0.6 + 0.2, 6)),
        4: ("bank", "generic", 0.5), 5: (None, "none", 0.0), 6: (None, "no_type", 0.0),
    }


def test_key_values(spark):
    lines = ["Account: 123-456", "Account: xyz", "Account", "my Account : abc, rest", "no key", "Name = Jane", None]
    frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
    keys = {"account": S.Key(r"Account ?:? ?([0-9-]+)?", 1, "[0-9-]+$"), "name": S.Key("Name", 0)}
    told = {(r.line_no, r.key_name): (r.value, r.confidence) for r in S.key_values(frame, keys).collect()}
    assert told == {(0, "account"): ("123-456", 0.9), (1, "account"): ("xyz", 0.7), (3, "account"): ("abc, rest", 0.7), (5, "name"): ("= Jane", 0.85)}


@pytest.mark.parametrize("country, address, expected", [
    ("SG", "1 Road, S 123456", "S 123456"), ("SG", "1 Road 654321", "654321"), ("SG", "1 Road 12345", "12345"), ("UK", "1 Road, sw1a 1aa", "sw1a 1aa"), ("HK", "1 Road 123456", None),
    ("FR", "PO Box 12345, 2000 Town", "2000"), ("FR", "Tel: 123456, 54321", None), ("FR", "Tel: 1234, 54321", "54321"), ("IN", "1234 Road, 560001", "560001"), ("IN", "1234 Road", None), ("FR", None, None), (None, "9999 Road", "9999"),
])
def test_postal_codes(spark, country, address, expected):
    code = S.postal_code(F.lit(address), F.lit(country).cast("string"), {"SG": [r"\bS\s?\d{6}\b", r"\b\d{6}\b"], "UK": [r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b"]}, ["HK"], {"IN": [r"\d{4}"]})
    assert spark.range(1).select(code.alias("c")).first().c == expected
