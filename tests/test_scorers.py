import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequery.functions import scorers as S

WORD = st.text("абв г", max_size=9)


def test_published_values():
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert S.partial_ratio("this is a test", "this is a test!") == 100
    assert S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert S.token_set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat") == pytest.approx(92.307692)
    assert S.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert S.quick_ratio("this is a test", "this is a new test") == pytest.approx(87.5)
    assert S.weighted_ratio("new york jets", "New York Jets") == pytest.approx(76.923077)


def lcs_slow(a, b):
    if not a or not b:
        return 0
    return 1 + lcs_slow(a[:-1], b[:-1]) if a[-1] == b[-1] else max(lcs_slow(a[:-1], b), lcs_slow(a, b[:-1]))


@settings(max_examples=60, deadline=None)
@given(st.text("аб", max_size=7), st.text("аб", max_size=7))
def test_lcs_is_exact(a, b):
    assert S.lcs(a, b) == lcs_slow(a, b)


@settings(max_examples=80, deadline=None)
@given(WORD, WORD, WORD)
def test_distances(a, b, c):
    assert S.levenshtein(a, b) == S.levenshtein(b, a) <= S.levenshtein(a, c) + S.levenshtein(c, b)
    assert S.levenshtein(a, b, (1, 1, 2)) == S.indel(a, b)
    assert S.damerau_levenshtein(a, b) <= S.osa(a, b) <= S.levenshtein(a, b) <= S.hamming(a, b)
    assert 0 <= S.jaro(a, b) <= S.jaro_winkler(a, b) <= 1
    for f in S.RATIOS.values():
        assert 0 <= f(a, b) <= 100.0001
    assert S.osa("ca", "abc") == 3 and S.damerau_levenshtein("ca", "abc") == 2


@settings(max_examples=80, deadline=None)
@given(WORD, WORD)
def test_scripts(a, b):
    for ops in (S.editops(a, b), S.editops(a, b, replace=False), S.hamming_editops(a, b)):
        S.validate(ops, len(a), len(b))
        assert S.apply(ops, a, b) == b
        assert S.apply(S.inverse(ops), b, a) == a
        codes = S.opcodes(ops, len(a), len(b))
        assert S.to_editops(codes) == ops
        assert sum(n for _, _, n in S.matching_blocks(codes, len(a), len(b))) == len(a) - sum(t != "insert" for t, _, _ in ops)
    assert len(S.editops(a, b)) == S.levenshtein(a, b)
    assert S.remove_subsequence(S.editops(a, b), []) == S.editops(a, b)


def test_empty_and_errors():
    assert S.ratio("", "") == 100 and S.quick_ratio("", "") == 0 and S.token_set_ratio("", "а") == 0
    assert S.function("lcs_seq_normalized_distance")("", "а") == 0
    assert S.function("prefix_normalized_similarity")("", "") == 1
    with pytest.raises(ValueError):
        S.hamming("а", "аб", pad=False)
    with pytest.raises(ValueError):
        S.remove_subsequence([], [("insert", 0, 0)])
    with pytest.raises(ValueError):
        S.validate([("delete", 3, 0)], 1, 1)
    with pytest.raises(KeyError):
        S.function("unknown")


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([("а", None), (None, "б"), ("аб", "аб")], "a string, b string")
    r = df.select(S.column("ratio")("a", "b").alias("r"), S.column("levenshtein_distance")("a", "b").alias("d"), S.script_column()("a", "b").alias("s")).collect()
    assert [x.r for x in r] == [0, 0, 100] and [x.d for x in r] == [None, None, 0] and r[0].s is None and r[2].s == []
