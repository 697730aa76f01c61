"""What personal data turns into."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from qaloom.llm.surrogates import distinct_surrogates, pseudonymized

TEXTS = {
    0: None,
    1: "",
    2: "nothing personal, version 4.0. and 3. of 2024",
    3: "mail ana.01@mail7.example.com or ANA.01@MAIL7.EXAMPLE.COM!! and bo@mail7.example.com",
    4: "call +1 (017) 555-7713, +1-017-555-7713 or (017) 555-7713",
    5: "hosts 96.153.118.61 and 96.153.118.61!! not 1.2.3 nor 999.1.1.1",
    6: "cards 4111111111111111 and 4111 1111 1111 1111, 5927243074273351!!",
    7: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 123-45-6789',
    8: "Frau Anna Schmidt und Herr Anna, г-жа Иванова",
    9: "ana.01@mail7.example.com",
    10: "x" * 20_000 + " ñu.80@a.example.com " + "y@" * 5000,
    11: "DE44 5001 0517 5407 3249 31",
}


def run(spark, key="k"):
    rows = [(i, t, 5) for i, t in TEXTS.items()] + [(3, TEXTS[3], 5), (None, TEXTS[5], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int").repartition(3)
    return [(r.doc_id, r.text, r.entities) for r in pseudonymized(docs, key).collect()]


def test_surrogates(spark):
    got = run(spark)
    new = {i: t for i, t, _ in got}
    count = {i: n for i, _, n in got}
    assert len(got) == len(TEXTS) + 2
    assert all(new[i] == TEXTS[i] and count[i] == 0 for i in (0, 1, 2))
    mail = re.findall(r"\S+@[\w.]+\w", new[3])
    assert mail[0].upper() == mail[1] and mail[0] == new[9] != TEXTS[9]
    assert mail[0].split("@")[1] == mail[2].split("@")[1] and mail[0].endswith(".com") and "mail7" not in new[3].lower()
    assert re.fullmatch(r"[a-z]{3}\.\d\d", mail[0].split("@")[0])
    phones = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3})-(\d{4})", new[4])
    assert len(phones) == 2 and phones[0] == phones[1] and "7713" not in new[4]
    hosts = re.findall(r"\d+\.\d+\.\d+\.\d+", new[5])
    assert hosts[0] == hosts[1] != "96.153.118.61" and hosts[2] == "999.1.1.1" and all(0 < int(x) < 255 for x in hosts[0].split("."))
    cards = re.findall(r"\d{16}|\d{4}(?: \d{4}){3}", new[6])
    assert cards[0] == cards[1].replace(" ", "") != cards[2]
    valid = lambda n: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(n))) % 10 == 0
    assert valid(cards[0]) and not valid(cards[2]) and not valid("5927243074273351")
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d\d-\d{4}', new[7]) and "04dbeb" not in new[7] and "6789" not in new[7]
    names = re.fullmatch(r"Frau (\w+a) (\w+a) und Herr (\w+n), г-жа ([А-Я][а-я]+на)", new[8])
    assert names and "Schmidt" not in new[8] and "Иванова" not in new[8]
    assert new[10].startswith("x" * 20_000) and "ñu.80" not in new[10] and new[10].endswith("y@")
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", new[11]) and new[11] != TEXTS[11]
    assert count[None] == 2 and [t for i, t, _ in got if i == 3] == [new[3]] * 2


def test_key_decides(spark):
    one, again, other = ({i: t for i, t, _ in run(spark, key)} for key in ("k", "k", "other"))
    assert one == again and one[9] != other[9]


def test_distinct_entities_stay_distinct(spark):
    """A form with few values: half of its hundred are taken, and none may be met twice."""
    canons = [f"1|{i:02d}" for i in range(0, 100, 2)]
    entities = spark.createDataFrame([("phone", c) for c in canons] * 2, "kind string, canon string")
    chosen = distinct_surrogates(entities, "k").collect()
    assert sorted(r.canon for r in chosen) == canons
    assert len({r.chosen for r in chosen}) == len(canons) and not {r.chosen for r in chosen} & set(canons)


def test_plan_is_native_and_empty_tables_pass(spark):
    docs = spark.createDataFrame([(1, "a@b.example.com")], "doc_id long, text string")
    plan = pseudonymized(docs, "k")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert pseudonymized(docs.limit(0), "k").count() == 0
    assert pseudonymized(docs.withColumn("th", F.lit(1)), "k").columns == ["doc_id", "text", "th", "entities"]
