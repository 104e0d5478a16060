import math
import uuid
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from factloom.functions import ids as I
from factloom.functions import labels as L
from factloom.functions import text as X
from factloom.functions import urls as U
from factloom.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_fold_and_tokens(spark):
    assert one(spark, X.fold(F.col("t")), t="Straße ſ") == "strasse s"
    assert one(spark, X.word_tokens(F.col("t")), t="Über straße_x a v1.2") == ["über", "strasse_x", "v1.2"]


def test_multiset_recall_counts_repetition(spark):
    assert one(spark, X.lexical_score(F.col("q"), F.col("t")), q="aa aa bb", t="aa cc bb bb") == pytest.approx(2 / 3)
    assert one(spark, X.lexical_score(F.col("q"), F.col("t")), q="", t="aa") == 0.0


def test_exact_match(spark):
    q = 'He said "green tea" in 2019 with NASA and Mary Ann'
    assert one(spark, X.exact_needles(F.col("q")), q=q) == ["green tea", "2019", "nasa", "mary ann"]
    assert one(spark, X.exact_match_score(F.col("q"), F.col("t")), q=q, t="GREEN TEA and NASA") == 0.5


def test_signals_and_boost(spark):
    t = 'Acme Corp sold "blue widgets" on 2024-01-05, model AB-1234, for 40%'
    s = one(spark, X.exact_signals(F.col("t")), t=t)
    assert "blue widgets" in s["quotes"] and "2024-01-05" in s["dates"] and "AB-1234" in s["identifiers"] and "Acme Corp" in s["names"]
    boost = one(spark, X.exact_signal_boost(X.exact_signals(F.col("t")), F.lower(F.col("t"))), t=t)
    assert boost == pytest.approx(0.28)


def test_statistics_drop_years_and_counters(spark):
    assert set(one(spark, X.statistics(F.col("t")), t="In 2019, 5 of 1,200 got $3.5 million or 12%")) == {"1200", "$3.5million", "12%"}


def test_shingles_and_jaccard(spark):
    assert one(spark, X.shingles(F.col("t")), t="a b c") == ["a b c"]
    assert one(spark, X.jaccard(X.shingles(F.col("a"), 2), X.shingles(F.col("b"), 2)), a="a b c d", b="a b c e") == pytest.approx(0.5)


def test_titles_and_tails(spark):
    assert one(spark, X.report_title(F.col("t")), t="Report") is None
    long = "word " * 40
    cut = one(spark, X.report_title(F.col("t")), t=long)
    assert len(cut) <= 96 and cut.endswith("word…")
    assert one(spark, X.tail_overlap(F.col("t"), 7), t="alpha beta gamma") == "gamma"
    assert one(spark, X.slug(F.col("t")), t="  ?? ") == "lite-source"


def test_quality_and_lines(spark):
    assert one(spark, X.extraction_quality(F.col("t")), t="") == 0.0
    assert one(spark, X.extraction_quality(F.col("t")), t="a\na\nb\n") == pytest.approx(round(0.65 * 6 / 2000 + 0.35 * 2 / 3, 4))
    assert one(spark, X.normal_lines(F.col("t")), t=" a  b \n\n c\t d") == "a b\nc d"


def test_table_rows(spark):
    assert one(spark, X.table_row_text(F.col("h"), F.col("c")), h=["A", ""], c=["1", "2"]) == "A: 1 | 2"
    assert one(spark, X.table_row_text(F.col("h"), F.col("c")), h=["A"], c=["1", "2"]) == "1 | 2"


def test_phrase_boundaries(spark):
    assert one(spark, X.contains_phrase(F.col("t"), "u.s."), t="in the U.S. now")
    assert not one(spark, X.contains_phrase(F.col("t"), "rate"), t="separate")
    assert one(spark, X.contains_any(F.col("t"), ["pay grid", "wage"]), t="the Wage was")


def test_canonical_urls(spark):
    u = "HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1&gclid=9#top"
    assert one(spark, U.canonical_url(F.col("u")), u=u) == "http://www.example.com/a/?a=1&b=2"
    assert one(spark, U.source_url(F.col("u")), u=u) == "http://www.example.com/a?b=2&utm_source=x&a=1&gclid=9"
    assert one(spark, U.canonical_url(F.col("u")), u="ftp://x.org/") is None
    assert one(spark, U.canonical_url(F.col("u"), idna=True), u="https://bücher.de/x") == "https://xn--bcher-kva.de/x"
    assert one(spark, U.domain_suffixes(F.col("u")), u="a.b.c") == ["a.b.c", "b.c", "c"]


def test_public_addresses(spark):
    df = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("::1",), ("x",)], "a string")
    assert [r[0] for r in df.select(U.is_public_address("a")).collect()] == [True, False, False, False]


def test_ids_equal_the_standard_ones(spark):
    for name in ("a", "factloom:ü", "x" * 100):
        assert one(spark, I.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, I.sorted_json(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) is None
    v = V.fixture_vector("x", 64)
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1, abs=1e-6) and v == V.fixture_vector("x", 64)


def test_quality_golden(spark):
    c = L.evidence_quality(**{k: F.lit(v) for k, v in zip(L.QUALITY_WEIGHTS, (1, 1, 0.9, 0.8, 0.7, 0.6), strict=True)})
    assert float(one(spark, c)) == pytest.approx(0.88)


def test_score_goldens(spark):
    q = L.quote_fidelity(wording=F.lit(100), speaker_identity=F.lit(80), completeness=F.lit(60), sequence_integrity=F.lit(40), translation_accuracy=F.lit(20))
    assert one(spark, q) == pytest.approx(71)
    q = L.quote_fidelity(wording=F.lit(100), speaker_identity=F.lit(80), completeness=F.lit(60), sequence_integrity=F.lit(40), translation_accuracy=F.lit(None).cast("double"))
    assert one(spark, q) == pytest.approx(76.66666666666667)
    i = L.source_independence(origins=F.lit(100), primary_sources=F.lit(80), organizations=F.lit(50), methods=F.lit(40))
    assert one(spark, i) == pytest.approx(76)
    assert one(spark, L.context_completeness(F.array(F.lit("key_term_undefined"), F.lit("correlation_as_causation"), F.lit("key_term_undefined")))) == 55


@pytest.mark.parametrize(("score", "label"), [(90, "Supported"), (89, "Mostly supported"), (75, "Mostly supported"), (74, "Leaning supported"), (59, "Mixed"), (39, "Leaning contradicted"), (25, "Mostly contradicted"), (10, "Contradicted")])
def test_label_boundaries(spark, score, label):
    assert one(spark, L.support_label(F.lit(score))) == label


def test_gates(spark):
    f, t = F.lit(False), F.lit(True)
    n = F.lit(None).cast("double")
    assert one(spark, L.claim_label(n, F.lit(90), F.lit(90), f)) == "Insufficient evidence"
    assert one(spark, L.claim_label(F.lit(80), F.lit(34), F.lit(90), f)) == "Insufficient evidence: leans supported"
    assert one(spark, L.claim_label(F.lit(80), F.lit(90), F.lit(49), f)) == "Technically supported but misleading"
    assert one(spark, L.article_label(F.lit(95), F.lit(90), F.lit(90), f, t)) == "Mostly supported"


def test_budget(spark):
    b = one(spark, L.search_budget(F.lit("QUICK"), F.lit(3), F.lit(True)))
    assert (b["mandatory_floor"], b["total"], b["phase_one"]) == (7, 22, 8)
    assert one(spark, L.search_budget(F.lit("QUICK"), F.lit(13), F.lit(False)))["total"] is None


def test_sequence_ratio_is_difflib(spark):
    from factloom.operators.provenance import sequence_ratio

    pairs = [("abcd", "bcde"), ("", "x"), ("the cat sat", "the cat sat down")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(sequence_ratio("a", "b")).collect()]
    want = [SequenceMatcher(None, *sorted(p, key=len), autojunk=False).ratio() if all(p) else 0.0 for p in pairs]
    assert got == pytest.approx(want)
    assert Counter(got)
