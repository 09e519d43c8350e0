"""Published and agreed values of every kernel."""

import hashlib
import math
import re
from pathlib import Path

import ahocorasick
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import digest, entropy, minhash, patterns, shingle, text
from granary.functions.blake3 import blake3, blake3_many
from granary.functions.chunks import split
from granary.functions.logs import parse_line
from granary.operators import dedup
from granary.operators.pattern_search import contaminated, distinct_patterns, match_rows, match_rows_by_join
from granary.sources.files import hash_file, hash_files

FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def strings(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i bigint, s string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


# ---- shingles


def test_shingles(spark):
    cases = {
        "The quick brown fox": ["the quick brown", "quick brown fox"], "one": ["one"], "one two": ["one two"], "one, two; three": ["one two three"], "  ,.  ": [], "": [],
        "a b c a b c a b c": ["a b c", "b c a", "c a b"],
    }
    assert values(strings(spark, *cases), shingle.word_shingles("s")) == list(cases.values())
    chars = {"日本語の文": ["日本語", "本語の", "語の文"], "東京、 大阪。": ["東京大", "京大阪"], "日本": ["日本"], "": []}
    assert values(strings(spark, *chars), shingle.char_shingles("s")) == list(chars.values())
    assert values(strings(spark, "ΟΔΟΣ ΣΑΣ", "STRASSE Straße"), shingle.words("s")) == [["οδος", "σας"], ["strasse", "straße"]]
    assert values(strings(spark, None), shingle.word_shingles("s")) == [None]


def test_shingle_digest_and_separators(spark):
    assert len(shingle.separators()) == 136
    assert values(strings(spark, "", "abc"), shingle.shingle_digest(shingle.shingles("s", "word"))) == ["da39a3ee5e6b4b0d3255bfef95601890afd80709", "03cfd743661f07975fa2f1220c5194cbaff48451"]
    with pytest.raises(ValueError):
        shingle.shingles("s", "line")


def test_text_signatures(spark):
    texts = ["The quick  brown fox, the QUICK brown fox", "two words", "one", "", " . ", None, "\u6771\u4eac\u3067\u3001\u98df\u3079\u308b", "\u0130stanbul \u0130 x"]
    df = strings(spark, *texts)
    m = minhash.MinHasher(8)
    for mode, cut in (("word", shingle.word_shingles), ("char", shingle.char_shingles)):
        want = {r["i"]: r["signature"] for r in m.signatures(df.select("i", cut("s").alias("items")), "items").collect()}
        assert {r["i"]: r["signature"] for r in m.text_signatures(df, "s", mode).collect()} == want


def test_paragraphs_of_any_white_space(spark):
    one, two = "\u6bb5\u843d" * 20, "\u7b2c\u4e8c" * 20
    assert values(strings(spark, f"\u3000{one}\n\u3000\n{two}\u2028"), shingle.paragraphs("s")) == [[one, two]]


def test_paragraphs(spark):
    long = "x" * 40
    assert values(strings(spark, f"short\n\n  {long} \n \n{long}y"), shingle.paragraphs("s")) == [[long, long + "y"]]


# ---- MinHash


def sign(spark, family, *sets):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i bigint, s array<string>")
    return [r[1] for r in family.signatures(df, "s").orderBy("i").collect()]


def test_minhash_golden(spark):
    assert sign(spark, minhash.MinHasher(8, 1), ["hello", "world"]) == [[1255611051, 658569228, 453856259, 3032158293, 1637026616, 1348343608, 1081391673, 2120294805]]
    assert sign(spark, minhash.MinHasher(4, 42), [], None) == [[4294967295] * 4, None]
    family = minhash.MinHasher(64, 7)
    a, b = sign(spark, family, [f"t{i}" for i in range(50)], [f"t{i}" for i in range(25, 75)])
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    assert df.select(minhash.jaccard("a", "b")).first()[0] == 0.34375


def test_minhash_merge_update_and_jvm_hashes(spark):
    family = minhash.MinHasher(32, 1)
    ab, c, abc, none = sign(spark, family, ["a", "b"], ["c"], ["c", "a", "b", "a"], [])
    df = spark.createDataFrame([(ab, c, none, ["c", "b"], "c")], "ab array<bigint>, c array<bigint>, none array<bigint>, items array<string>, item string")
    row = df.select(minhash.merge("ab", "c"), family.update("ab", "item"), family.update_batch("ab", "items"), minhash.merge("ab", "none"), family.empty(), minhash.item_hashes("items")).first()
    assert list(row)[:4] == [abc, abc, abc, ab] and row[4] == [4294967295] * 32
    assert row[5] == minhash.mixed_hashes(["c", "b"]).tolist()
    with pytest.raises(Exception, match="lengths"):
        df.select(minhash.merge("ab", F.slice("c", 1, 3))).collect()


def test_minhash_arguments():
    for bad in (0, -1):
        with pytest.raises(ValueError):
            minhash.MinHasher(bad)
    with pytest.raises(ValueError):
        minhash.MinHasher(8, 1 << 32)
    with pytest.raises(TypeError):
        minhash.MinHasher("8")
    # A longer family begins with the odd multipliers of a shorter one.
    assert all(a % 2 for a in minhash.permutations(100, 3)[0])


# ---- digests


def test_blake3_vectors():
    vectors = re.findall(r"^\| (\d+) \| `([0-9a-f]{64})` \|$", FIXTURES, re.M)
    data = bytes(i % 251 for i in range(102400))
    assert len(vectors) == 35
    assert [d.hex() for d in blake3_many([data[: int(n)] for n, _ in vectors])] == [h for _, h in vectors]
    assert blake3(b"a" * 1_000_000).hex() == "616f575a1b58d4c9797d4217b9730ae5e6eb319d76edef6549b46f4efe31ff8b"


def test_digest_columns(spark):
    df = spark.createDataFrame([(0, bytearray()), (1, bytearray(b"abc")), (2, None)], "i bigint, s binary")
    assert values(df, digest.hex_digest("sha-256", "s")) == [hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"abc").hexdigest(), None]
    assert values(df, digest.hex_digest("BLAKE3", "s"))[0] == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert values(df, digest.hex_digest("blake3", "s"))[2] is None
    with pytest.raises(ValueError):
        digest.hex_digest("md5", "s")
    same = df.filter("i = 1").select((digest.digest("sha256", "s") == digest.from_hex("sha256", F.upper(F.sha2("s", 256)))).alias("x"), digest.is_hex_digest(F.lit("0" * 63)).alias("y")).first()
    assert same == (True, False)
    with pytest.raises(Exception, match="64 hex digits"):
        df.select(digest.from_hex("sha256", F.lit("xyz"))).collect()


@given(st.binary(max_size=3000), st.lists(st.integers(0, 3000), max_size=4), st.sampled_from(digest.ALGORITHMS))
@settings(max_examples=30, deadline=None)
def test_hasher_chunking_never_matters(data, cuts, algorithm):
    h = digest.Hasher(algorithm)
    edges = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    for a, b in zip(edges, edges[1:]):
        h.update(data[a:b])
        h.digest()
    assert h.digest() == digest.Hasher(algorithm, data).digest() == h.copy().finalize()
    assert algorithm == "blake3" or h.hexdigest() == hashlib.sha256(data).hexdigest()


def test_files(spark, tmp_path):
    paths = []
    for i, data in enumerate((b"one", b"two", b"")):
        p = tmp_path / f"f{i}"
        p.write_bytes(data)
        paths.append(str(p))
    got = [r["hexdigest"] for r in hash_files(spark, "sha256", paths[::-1]).collect()]
    assert got == [hashlib.sha256(d).hexdigest() for d in (b"", b"two", b"one")]
    assert hash_file(spark, "blake3", paths[0]) == blake3(b"one").hex()
    with pytest.raises(Exception):
        hash_file(spark, "sha256", str(tmp_path / "missing"))


def test_dedup_operators(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None)], "id bigint, d string")
    assert [tuple(r) for r in dedup.duplicate_groups(df, "d", "id").collect()] == [("a", 2, 2)]
    assert sorted(r["id"] for r in dedup.keep_first(df, "d", "id").collect()) == [1, 2, 4]
    odd = spark.createDataFrame([("a", 1), ("b", 1), ("b", 0), ("c", None), (None, 7), (None, 8)], "d string, id bigint")
    assert sorted((tuple(r) for r in dedup.keep_first(odd, "d", "id").collect()), key=str) == sorted([("a", 1), ("b", 0), ("c", None), (None, 7)], key=str)
    assert dedup.duplicate_groups(df.limit(0), "d", "id").count() == 0


# ---- patterns


def found(spark, pats, hay, method="find_all", **k):
    m = patterns.Matcher(pats)
    df = spark.createDataFrame([(hay if isinstance(hay, str) else bytearray(hay),)], "s string" if isinstance(hay, str) else "s binary")
    return [tuple(x) for x in df.select(getattr(m, method)("s", **k)).first()[0]]


def test_patterns_golden(spark):
    p = ["he", "she", "his", "hers"]
    assert found(spark, p, "ushers") == [(1, 1, 4), (0, 2, 4), (3, 2, 6)]
    assert found(spark, p, "ushers", "find_longest") == [(1, 1, 4)]
    p = ["a", "aa", "aaa", "b", "ab", "bab"]
    assert [(e - 1, i) for i, _, e in found(spark, p, "aaaabab")] == [(0, 0), (1, 1), (1, 0), (2, 2), (2, 1), (2, 0), (3, 2), (3, 1), (3, 0), (4, 4), (4, 3), (5, 0), (6, 5), (6, 4), (6, 3)]
    assert [(e - 1, i) for i, _, e in found(spark, p, "aaaabab", "find_longest")] == [(2, 2), (4, 4), (6, 4)]
    assert found(spark, ["b", "abb"], "ab", "find_longest") == [(0, 1, 2)]
    assert found(spark, ["b", "abb"], "abbab", "find_longest") == [(1, 0, 3), (0, 4, 5)]
    assert found(spark, ["baa", "a"], "ba", "find_longest") == [(1, 1, 2)]
    assert found(spark, ["", "b", ""], "abc") == [(1, 1, 2)]
    assert found(spark, ["x", "y", "x", "x"], "xyx") == [(0, 0, 1), (1, 1, 2), (0, 2, 3)]
    assert found(spark, ["abc", "ab", "a", "bc", "c"], "abc") == [(2, 0, 1), (1, 0, 2), (0, 0, 3), (3, 1, 3), (4, 2, 3)]
    assert found(spark, ["a", "aa"], "aaa", limit=2) == [(0, 0, 1), (1, 0, 2)]
    assert found(spark, ["東京", "😀", "log"], "ログ😀東京 log") == [(1, 2, 3), (0, 3, 5), (2, 6, 9)]
    assert found(spark, ["東京".encode(), "😀".encode()], "ログ😀東京 log".encode()) == [(1, 6, 10), (0, 10, 16)]
    assert found(spark, [], "abc") == []


def test_pattern_types():
    with pytest.raises(TypeError):
        patterns.Matcher("abc")
    with pytest.raises(TypeError):
        patterns.Matcher(["a", b"b"])
    m = patterns.Matcher(["", "b", ""])
    assert (m.pattern_count, m.distinct_pattern_count, m.kind, len(m)) == (3, 1, "str", 3)
    assert patterns.Matcher([]).kind == "empty"


@given(st.lists(st.text("ab", max_size=4), max_size=6), st.text("abc", max_size=25))
@settings(max_examples=60, deadline=None)
def test_matches_against_naive(pats, hay):
    m = patterns.Matcher(pats)
    naive = sorted(((a + len(p), a, i) for p, i in m.ids.items() for a in range(len(hay)) if hay.startswith(p, a)))
    assert [(e, a, i) for i, a, e in zip(*(x.tolist() for x in m._found(m._automaton(), hay)))] == naive
    assert isinstance(m._automaton(), ahocorasick.Automaton)


def test_pattern_tables(spark):
    docs = spark.createDataFrame([(1, "ushers he"), (2, None), (3, ""), (4, "xyz")], "id bigint, t string")
    pats = spark.createDataFrame([(5, "he"), (3, "she"), (9, "he"), (7, ""), (8, None)], "p bigint, s string")
    rows = sorted(tuple(r) for r in match_rows(docs, "id", "t", pats, "p", "s").collect())
    assert rows == [(1, 3, 1, 4), (1, 5, 2, 4), (1, 5, 7, 9)]
    assert sorted(tuple(r) for r in match_rows_by_join(docs, "id", "t", distinct_patterns(pats, "p", "s")).collect()) == rows
    assert [r[0] for r in contaminated(docs, "id", "t", pats, "p", "s").collect()] == [1]
    assert match_rows_by_join(docs, "id", "t", distinct_patterns(pats.limit(0), "p", "s")).count() == 0


# ---- entropy


def test_entropy_golden(spark):
    cases = {
        b"hello world": 2.8453509366224368, b"abc": 1.584962500721156, b"aab": 0.9182958340544894, b"The quick brown fox jumps over the lazy dog": 4.431965045349459,
        bytes(i % 251 for i in range(1000)): 7.970764734653433, bytes(range(256)) * 3 + b"x": 7.999718444591623, b"": 0.0, b"aaaa": 0.0, bytes(range(256)): 8.0, bytes(range(16)): 4.0,
    }
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(cases)], "i bigint, s binary")
    got = values(df, entropy.entropy("s"))
    assert got == list(cases.values())
    assert math.copysign(1, got[7]) == 1
    stored = spark.createDataFrame(list(enumerate(values(df, entropy.histogram("s")))), "i bigint, h array<bigint>")
    assert values(stored, F.round(entropy.entropy_of_histogram("h"), 9)) == [round(x, 9) for x in cases.values()]


def test_histogram_and_windows(spark):
    data = bytes(i % 7 for i in range(1003))
    df = spark.createDataFrame([(0, bytearray(data))], "i bigint, s binary")
    h = values(df, entropy.histogram("s"))[0]
    assert (h[0], h[6], h[7], len(h)) == (144, 143, 0, 256)
    w = values(df, entropy.windows("s", 100, 30))[0]
    assert [x["offset"] for x in w] == list(range(0, 904, 30))
    assert [x["entropy"] for x in w] == [entropy.entropy_of_counts(entropy.counts_of(data[a : a + 100])) for a in range(0, 904, 30)]
    assert values(df, entropy.window_count(F.octet_length("s"), 100, 30)) == [31]
    assert values(df, entropy.window_count(F.lit(99), 100)) == [0]
    for bad in ((0, 1), (4, 0), (-1, None)):
        with pytest.raises(ValueError):
            entropy.windows("s", *bad)
    with pytest.raises(Exception, match="256"):
        df.select(entropy.entropy_of_histogram(F.array(F.lit(1).cast("long")))).collect()


@given(st.binary(max_size=600))
@settings(max_examples=40, deadline=None)
def test_entropy_bounds_and_order(data):
    h = entropy.entropy_of_counts(entropy.counts_of(data))
    assert 0 <= h <= 8 + 1e-12
    assert entropy.entropy_of_counts(entropy.counts_of(data[::-1])) == h
    assert np.array_equal(entropy.counts_of(data) + entropy.counts_of(b"xy"), entropy.counts_of(data + b"xy"))


# ---- Unicode


def test_normal_forms(spark):
    table = {
        "Å": ("Å", "Å", "Å", "Å"), "ﬁ": ("ﬁ", "ﬁ", "fi", "fi"), "ｶﾞ": ("ｶﾞ", "ｶﾞ", "ガ", "ガ"),
        "한": ("한", "한", "한", "한"), "豈": ("豈",) * 4, "q̣̇": ("q̣̇",) * 4,
        "ḍ̇": ("ḍ̇", "ḍ̇", "ḍ̇", "ḍ̇"), "¨": ("¨", "¨", " ̈", " ̈"), "ﻻ": ("ﻻ", "ﻻ", "لا", "لا"),
        "①㈱㌔": ("①㈱㌔", "①㈱㌔", "1(株)キロ", "1(株)キロ"), "꟱": ("꟱",) * 4,
    }
    df = strings(spark, *table, None)
    for k, form in enumerate(text.FORMS):
        assert values(df, text.normal_form("s", form.lower())) == [v[k] for v in table.values()] + [None]
    assert values(strings(spark, "Å", "Å"), text.is_normalized("s")) == [False, True]
    assert values(strings(spark, "ﬁ", None), text.normal_form_python("NFKC")("s")) == ["fi", None]
    with pytest.raises(ValueError):
        text.normal_form("s", "NFX")


def test_cleaning(spark):
    assert values(strings(spark, "  a  b\n\nc\t", "a　b\u0085c\u001cd", "a​b"), text.fold_whitespace("s")) == ["a b c", "a b c d", "a​b"]
    kept = "❤️a͏ㅤ؀\U000e0100"
    assert values(strings(spark, "hi\U000e0001\U000e0069\U000e0067\U000e007f", kept), text.strip_invisible("s")) == ["hi", kept]
    raw = "﻿ﾃﾞｰﾀ　　ＡＩ​  "
    once = text.normalize("s", "NFKC", fold=True, strip=True)
    assert values(strings(spark, raw, "データ AI"), once) == ["データ AI"] * 2
    assert sum(b - a + 1 for a, b in text.INVISIBLE_RANGES) == 138 and sum(b - a + 1 for a, b in text.WHITESPACE_RANGES) == 29


def test_every_character_class(spark):
    every = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    row = spark.createDataFrame([(every,)], "s string").select(F.length(text.strip_invisible("s")), F.length(F.regexp_replace("s", text.WHITESPACE, ""))).first()
    assert row[0] == len(every) - 138
    assert row[1] == len(every) - sum(c.isspace() for c in every)


# ---- declared components


def test_chunks():
    body = "First paragraph here.\n\nSecond one. It has two sentences.\n\n" + "word " * 50
    spans = split(body, 60, 20)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(b - a <= 60 for a, b in spans) and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert split("", 10, 0) == [] and split("x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]


def test_logs(spark):
    df = strings(spark, "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - 'su root' failed", "nonsense")
    a, b = values(df, parse_line("rfc5424", "s"))
    assert (a["facility"], a["severity"], a["host"], a["app"], a["pid"], a["msgid"], a["data"], a["message"]) == (4, 2, "mymachine.example.com", "su", None, "ID47", None, "'su root' failed")
    assert b is None
    r = values(strings(spark, "<34>Oct 11 22:14:15 mymachine su: 'su root' failed on /dev/pts/8"), parse_line("rfc3164", "s"))[0]
    assert (r["host"], r["app"], r["message"]) == ("mymachine", "su", "'su root' failed on /dev/pts/8")
    r = values(strings(spark, '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326'), parse_line("access", "s"))[0]
    assert (r["host"], r["user"], r["method"], r["path"], r["status"], r["bytes"]) == ("127.0.0.1", "frank", "GET", "/apache_pb.gif", "200", "2326")
    with pytest.raises(ValueError):
        parse_line("xml", "s")
