from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termloom.functions import codes as C, rules as R, text as X
from termloom.operators.search import segment_han, segments_of


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("oedema", "edema"),
        ("angioedema", "angioedema"),
        ("Haemangioma!", "hemangioma"),
        ("Athlete's foot", "athlete foot"),
        ("v1.2. End.", "v1.2 end"),
        ("臺灣  著", "台灣 著"),
        ("", ""),
        (None, None),
    ],
)
def test_normalise(spark, raw, want):
    assert one(spark, raw, X.normalise) == want


def test_normalise_folds_full_width(spark):
    assert one(spark, "ＨＳＶ　感染", lambda c: X.normalise(c, fold=True)) == "hsv 感染"


@pytest.mark.parametrize("w, want", [("lupus", "lupus"), ("warts", "wart"), ("bodies", "body"), ("boxes", "box"), ("bus", "bus"), ("as", "as"), ("b12s", "b12s"), ("class", "class"), ("ties", "tie")])
def test_stem(spark, w, want):
    assert one(spark, w, X.stem) == want


def test_phrase_key_ignores_order(spark):
    assert one(spark, "atopic dermatitis", lambda c: X.phrase_key(X.normalise(c))) == one(spark, "Dermatitis, atopic", lambda c: X.phrase_key(X.normalise(c)))


def test_tokens_of_mixed_text(spark):
    assert one(spark, "hsv感染症 of warts", X.tokens) == ["hsv", "wart", "感染", "染症"]


@pytest.mark.parametrize("raw, want", [("L400", "L40.0"), ("l40.0", "L40.0"), ("S72001A", "S72.001A"), ("C4A", "C4A"), ("9999", None), ("", None), (None, None)])
def test_canonical(spark, raw, want):
    assert one(spark, raw, C.canonical) == want


def test_lineage(spark):
    assert one(spark, "L40.51", C.lineage) == ["L40.51", "L40.5", "L40"]
    assert one(spark, "L40", C.lineage) == ["L40"]


def test_specs(spark):
    got = one(spark, "see (N18.1-N18.6), (E10.-) and (Z79.4) T1D", C.specs)
    assert [(s["first"], s["last"], s["prefix"]) for s in got] == [("N18.1", "N18.6", None), (None, None, "E10"), (None, None, "Z79.4")]
    assert one(spark, "E10 without brackets", C.specs) == []


@pytest.mark.parametrize("code, first, last, want", [("N18.30", "N18.1", "N18.6", True), ("N18.9", "N18.1", "N18.6", False), ("C96.4", "C00", "C96", True)])
def test_in_range(spark, code, first, last, want):
    df = spark.createDataFrame([(code, first, last)], "c string, a string, b string")
    assert df.select(C.in_range(F.col("c"), F.col("a"), F.col("b"))).first()[0] is want


@pytest.mark.parametrize("a, b, most, want", [("hievs", "hives", 1, 1), ("ca", "abc", 3, 3), ("kitten", "sitting", 3, 3), ("abc", "xyz", 1, 2), ("", "", 1, 0)])
def test_osa(a, b, most, want):
    assert R.osa(a, b, most) == want


def test_side_of():
    assert R.side_of("cellulitis of left leg")["strip"] == "cellulitis of leg"
    assert R.side_of("左耳外耳炎")["strip"] == "外耳炎"
    assert R.side_of("右膝退化性關節炎")["strip"] == "膝退化性關節炎"
    for none in ("左心室肥大", "雙極性情感疾患", "left eye and right ear", "", None):
        assert R.side_of(none) is None


def test_coverage():
    assert R.coverage_of("qwxz怪皮病zz", "皮病") < 0.5
    assert R.coverage_of("cellulitis of leg", "Cellulitis of left lower limb") >= 0.5
    assert R.coverage_of("asthma", "Asthma") == 1
    assert R.coverage_of("", "x") == 1


def test_parsed(spark):
    def ask(raw, scope="cm"):
        return one(spark, raw, lambda c: R.parsed(c, scope)).asDict(recursive=True)

    assert ask("696.1")["codes"][0]["kind"] == "icd9"
    assert ask("E800")["codes"] == [{"kind": "cm", "code": "E80.0", "last": None}]
    assert ask("9:E800.0")["codes"][0] == {"kind": "icd9", "code": "E800.0", "last": None}
    assert ask("14: E800 pain")["codes"][0] == {"kind": "icd14", "code": "E80.0", "last": None}
    assert ask("A00-B03.1")["codes"] == [{"kind": "range", "code": "A00", "last": "B03.1"}]
    q = ask('asthma "status x" -acute [noexp]')
    assert (q["text"], q["phrases"], q["neg"], q["noexp"], q["mh"]) == ("asthma status x", ["status x"], ["acute"], True, False)
    assert ask("B31S010", "pcs")["codes"][0]["kind"] == "pcs"
    q = ask("l40.0 of  knee - x")
    assert (q["text"], q["codes"]) == ("of knee - x", [{"kind": "cm", "code": "L40.0", "last": None}])
    assert ask(None)["text"] == "" and ask(None)["codes"] == []


@pytest.mark.parametrize("raw, text, tag", [("1. Type 2 DM", "Type 2 DM", None), ("2) r/o cellulitis", "cellulitis", "r/o"), ("③ 異位性皮膚炎", "異位性皮膚炎", None), ("Dx: L400", "L400", None), ("s/p appendectomy", "appendectomy", "s/p")])
def test_lines(spark, raw, text, tag):
    df = spark.createDataFrame([(raw,)], "x string").select(R.line_text(F.col("x")).alias("t"))
    assert tuple(df.select(R.line_body(F.col("t")), R.line_tag(F.col("t"))).first()) == (text, tag)


def test_segments():
    assert segment_han("腎臟病變", {"腎臟", "病變"}) == [("腎臟", True), ("病變", True)]
    assert segment_han("左腎臟", {"腎臟"}) == [("左", False), ("腎臟", True)]
    assert segments_of("acute atopic dermatitis x", {"atopic dermatitis"}, set()) == [("acute", False), ("atopic dermatitis", True), ("x", False)]


def test_facets(spark):
    df = spark.createDataFrame([("Nondisplaced closed fracture of right hip, initial encounter", 1), ("Unilateral hernia", 0)], "en string, use int")
    a, b = df.select(*(c.alias(k) for k, c in R.facets(F.col("en"), F.col("use")).items())).collect()
    assert (a.lat, a.enc, a.fx, a.dsp, a.use) == ("右側", "初次照護", "閉鎖性", "無移位", "可申報")
    assert (b.lat, b.enc, b.use) == ("單側", None, "標題碼")


def test_typo_changes_one_long_word(spark):
    df = spark.range(20).select(R.typo(F.lit("acute dermatitis"), F.col("id")).alias("t"))
    for r in df.collect():
        assert r.t.startswith("acute ") and abs(len(r.t) - len("acute dermatitis")) <= 1


def test_highlights_merge():
    assert R.highlights_of("left leg leg", "leg left") == [{"start": 0, "end": 4}, {"start": 5, "end": 8}, {"start": 9, "end": 12}]
