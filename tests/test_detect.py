"""Detection, phrases, inputs and reports."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as fn
from veilspark.operators import detect, phrases
from veilspark.operators import settings as prefs
from veilspark.sources import texts as src

GOLDEN = [
    ("Email me@example.com, card 4242 4242 4242 4242, IP 192.168.1.5, not 999.999.1.1", (), [(6, 20, "email"), (27, 46, "card"), (51, 62, "ip")]),
    ("PESEL 44051401458 invalid 44051401459", (), [(6, 17, "pesel"), (26, 37, "phone")]),
    ("Project NIGHTJAR", ("nightjar",), [(8, 16, "custom")]),
    ("contact cache@example.com", (), [(8, 25, "email")]),
    ("+48 123 456 789", (), [(0, 15, "phone")]),
    ("192.168.1.42", (), [(0, 12, "ip")]),
    ("Nothing sensitive here", (), []),
    ("contact secret.person@example.com or +48 987 654 321", (), [(8, 33, "email"), (37, 52, "phone")]),
    ("4242 4242 4242 4242", (), [(0, 19, "card")]),
    ("4242 4242 4242 4242 x", (), [(0, 20, "card")]),
    ("4242 4242 4242 4243", (), [(0, 19, "phone")]),
    ("4465758382889437 4465758382889437", (), [(0, 33, "phone")]),
    ("44051401458", (), [(0, 11, "pesel")]),
    ("44051401459", (), [(0, 11, "phone")]),
    ("IP 10.0.0.1.", (), []),
    ("10.0.0.256", (), []),
    ("001.002.003.004", (), [(0, 15, "ip")]),
    ("12345678901@x.com", (), [(0, 17, "email")]),
    ("0000000000000", (), [(0, 13, "card")]),
    ("call 1.2.3.4 1234567890 a", (), [(5, 12, "ip")]),
    ("123-45-6789", (), [(0, 11, "phone")]),
    ("😀 a@b.co", (), [(3, 9, "email")]),
    ("Le CAFÉ, le café!", ("café", ""), [(3, 7, "custom"), (12, 17, "custom")]),
    ("a.b a.b", ("a.b",), [(0, 3, "custom"), (4, 7, "custom")]),
    ("", (), []),
]


@pytest.mark.parametrize("with_phrases", sorted({g[1] for g in GOLDEN}))
def test_golden(spark, with_phrases):
    cases = [g for g in GOLDEN if g[1] == with_phrases]
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(cases)] + [(99, None)], "id long, t string")
    out = {r.id: [(x.start, x.end, x.kind) for x in r.detections] for r in detect.with_detections(df, "t", phrases=with_phrases).collect()}
    assert out.pop(99) == []
    assert out == {i: g[2] for i, g in enumerate(cases)}


def test_kinds_that_are_off(spark):
    df = spark.createDataFrame([(1, "NIGHTJAR a@b.co 10.0.0.1")], "id long, t string")
    kinds = [r.kind for r in detect.spans(detect.with_detections(df, "t", ("email",), ("nightjar",)), "id").collect()]
    assert kinds == ["email"]


def test_overlaps_against_all_pairs(spark):
    r = random.Random(4)
    lists = []
    for i in range(400):
        spans = [(s, r.choice(list(detect.PRIORITY)), r.randint(1, 9)) for s in (r.randint(0, 30) for _ in range(r.randint(0, 9)))]
        lists.append((i, [(s, -n, -detect.PRIORITY[k], s + n, k, "v") for s, k, n in spans]))
    df = spark.createDataFrame(lists, f"id long, c array<{detect.SPAN}>")
    for row in df.select("id", detect.resolved(F.col("c")).alias("got")).collect():
        kept = []
        for x in sorted(lists[row.id][1]):
            if all(x[3] <= y[0] or y[3] <= x[0] for y in kept):
                kept.append(x)
        assert [tuple(x) for x in row.got] == kept


def test_report_and_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now 10.0.0.1"), (2, "clean")], "id long, t string")
    found = detect.with_detections(df, "t")
    lines = [tuple(r) for r in detect.report(found, "id").orderBy("id", "line_no").collect()]
    assert lines == [(1, 0, "Email at characters 5-11"), (1, 1, "IP address at characters 16-24"), (2, 0, "No supported PII detected")]
    assert [r[0] for r in found.orderBy("id").select(detect.redacted("t")).collect()] == ["mail [email] now [ip]", "clean"]


def test_report_is_written(spark, tmp_path):
    found = detect.with_detections(spark.createDataFrame([(1, "mail a@b.co now"), (2, None)], "id long, t string"), "t")
    src.write_report(detect.report(found, "id"), f"{tmp_path}/report")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/report").collect()) == ["Email at characters 5-11", "No supported PII detected"]


def test_redaction_beyond_the_bmp(spark):
    df = spark.createDataFrame([(1, "😀 mail a@b.co 😀😀 now 10.0.0.1 end 😀"), (2, "😀a@b.co"), (3, "😀 clean"), (4, None)], "id long, t string")
    found = detect.with_detections(df, "t")
    got = [r[0] for r in found.orderBy("id").select(detect.redacted("t")).collect()]
    assert got == ["😀 mail [email] 😀😀 now [ip] end 😀", "😀[email]", "😀 clean", None]


def test_masking_against_plain_python(spark):
    r = random.Random(31)
    bits = ["😀", "a@b.co", " ", "é", "10.0.0.1", "x", "👍🏽", "+48 123 456 789", ". "]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(400)]
    for x in detect.with_detections(spark.createDataFrame(rows, "id long, t string"), "t").withColumn("masked", detect.redacted("t")).collect():
        units, out, at = x.t.encode("utf-16-be"), b"", 0
        for d in x.detections:
            assert units[2 * d.start : 2 * d.end].decode("utf-16-be") == d.value
            out += units[2 * at : 2 * d.start] + f"[{d.kind}]".encode("utf-16-be")
            at = d.end
        assert x.masked == (out + units[2 * at :]).decode("utf-16-be")


def test_many_matches_in_a_text(spark):
    """More matches than a block holds, and in time that doesn't grow with their square."""
    n = 30_000
    (r,) = detect.with_detections(spark.range(1).select(F.lit("😀 a@b.co " * n).alias("t")), "t").select(F.size("detections").alias("n"), F.element_at("detections", -1).alias("last"), F.length(detect.redacted("t")).alias("m")).collect()
    assert (r.n, r.last.start, r.last.end, r.m) == (n, 10 * (n - 1) + 3, 10 * (n - 1) + 9, 10 * n)


def test_settings_of_each_row(spark):
    rows = [(1, "NIGHTJAR a@b.co 10.0.0.1 café", ["email"], ["nightjar"]), (2, "NIGHTJAR a@b.co Cafe\u0301.", ["custom"], ["nightjar", "CAFÉ", "", None, "a.b"]), (3, "a@b.co", None, None), (4, "x\\y [z]", ["custom"], ["x\\Y", "[Z]"]), (5, None, ["email"], [])]
    df = spark.createDataFrame(rows, "id long, t string, kinds array<string>, phrases array<string>")
    out = {r.id: [(x.kind, x.value) for x in r.detections] for r in detect.with_detections(df, "t", F.col("kinds"), F.col("phrases")).collect()}
    assert out == {1: [("email", "a@b.co")], 2: [("custom", "NIGHTJAR"), ("custom", "Cafe\u0301")], 3: [], 4: [("custom", "x\\y"), ("custom", "[z]")], 5: []}


EDITS = [
    (["Café"], " CAFE ", None, "duplicate", ["Café"]),
    (["Nightjar", "Café"], "NIGHTJAR", 1, "duplicate", ["Nightjar", "Café"]),
    (["Nightjar", "Café"], "  Skylark  ", 1, "changed", ["Nightjar", "Skylark"]),
    (["Nightjar"], "Nightjar", 0, "unchanged", ["Nightjar"]),
    (["Nightjar"], "NIGHTJAR", 0, "changed", ["NIGHTJAR"]),
    (["a"], " \n\t", None, "unchanged", ["a"]),
    (["a"], "b", 5, "unchanged", ["a"]),
    (["a"], "b", -1, "unchanged", ["a"]),
    ([], "b", None, "changed", ["b"]),
]


def test_phrase_edits(spark):
    df = spark.createDataFrame([(i, *e[:3]) for i, e in enumerate(EDITS)], "id long, p array<string>, raw string, i int")
    out = df.select("id", phrases.edited(F.col("p"), F.col("raw"), F.col("i")).alias("x")).collect()
    assert {r.id: (r.x.status, r.x.phrases) for r in out} == {i: (e[3], e[4]) for i, e in enumerate(EDITS)}
    gone = df.select("id", phrases.removed(F.col("p"), F.lit(1)).alias("p")).collect()
    assert {r.id: r.p for r in gone} == {i: [x for j, x in enumerate(e[0]) if j != 1] for i, e in enumerate(EDITS)}
    assert [r.p for r in df.orderBy("id").select(phrases.removed(F.col("p"), F.lit(None).cast("int")).alias("p")).collect()] == [e[0] for e in EDITS]


def test_only_changes_are_stored(spark):
    kept = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "o long, phrases array<string>")
    edits = kept.where("o < 3").select("o", phrases.edited(F.col("phrases"), F.when(F.col("o") == 1, "A").otherwise("new")).alias("outcome"))
    assert sorted(map(tuple, phrases.persisted(kept, edits, "o").collect())) == [(1, ["a"], False), (2, ["b", "new"], True), (3, ["c"], False)]


def test_checksums(spark):
    df = spark.createDataFrame([("44051401458", True), ("44051401459", False), ("1", False), ("٤٤٠٥١٤٠١٤٥٨", True), ("𝟒𝟒𝟎𝟓𝟏𝟒𝟎𝟏𝟒𝟓𝟖", True), ("๔๔๐๕๑๔๐๑๔๕๘", True)], "v string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", fn.pesel_valid(fn.ascii_digits(F.col("v")))).collect())
    ips = spark.createDataFrame([("1.2.3.4", True), ("256.1.1.1", False), ("1.2.3", False), ("١.2.3.4", False)], "v string, ok boolean")
    assert all(r.ok == r.got for r in ips.withColumn("got", fn.ipv4_valid(F.col("v"))).collect())


def test_inputs_are_refused_not_cut(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * (1 << 20))
    (tmp_path / "b").write_bytes(b"x" * ((1 << 20) + 1))
    (tmp_path / "c").write_bytes(b"\xff\xfe")
    out = {r.path[-1]: (r.error, len(r.text or "")) for r in src.guarded_files(spark, str(tmp_path)).collect()}
    assert out == {"a": (None, 1 << 20), "b": ("too large", 0), "c": ("not UTF-8", 0)}
    assert src.argument_text(spark, "a", "b c").first().text == "a b c"


def test_settings(spark):
    rows = [("a", "delaySeconds", "5"), ("a", "clearMode", "safe"), ("a", "kind.Email", "false"), ("b", "clearMode", "?"), ("b", "captureFPS", "many")]
    out = {r.owner: r for r in prefs.settings(spark.createDataFrame(rows, "owner string, key string, value string"), "owner").collect()}
    assert (out["a"].delay_seconds, out["a"].clear_mode, out["b"].clear_mode, out["b"].fps) == (5.0, "safe", "balanced", 10)
    assert "email" not in out["a"].kinds and len(out["a"].kinds) == 5 and len(out["b"].kinds) == 6
    own = spark.createDataFrame(rows + [("a", "customPhrases", '["x", "é y"]'), ("b", "customPhrases", "oops")], "owner string, key string, value string")
    out = {r.owner: r for r in prefs.settings(own, "owner", spark.createDataFrame([("a",), ("c",), ("c",)], "owner string")).collect()}
    assert sorted(out) == ["a", "c"] and out["a"].phrases == ["x", "é y"] and (out["c"].clear_mode, out["c"].phrases, len(out["c"].kinds)) == ("balanced", [], 6)
    new = prefs.upserted(spark.createDataFrame(rows, "owner string, key string, value string"), spark.createDataFrame([("a", "clearMode", "quick")], "owner string, key string, value string"), ["owner", "key"])
    assert new.count() == 5 and new.where("value = 'quick'").count() == 1
