from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quirewise.functions import expr, geometry, patterns, text
from quirewise.operators.metadata import level_settings


def test_escape_ampersand_first(value):
    assert value(text.escape_markup(F.col("t")), t='Hi & <there> "q"') == 'Hi &amp; &lt;there&gt; "q"'


def test_unescape_ampersand_last(value):
    assert value(text.unescape_entities(F.col("t")), t="&amp;lt; &lt;b&gt;") == "&lt; <b>"


def test_template(value):
    got = value(text.fill_template("Page {n} of {total}", {"n": F.col("n"), "total": F.lit(2)}), n=1)
    assert got == "Page 1 of 2"


@pytest.mark.parametrize(
    ("raw", "quoted"),
    [("plain", "plain"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("l1\nl2", '"l1\nl2"'), ("a\rb", '"a\rb"')],
)
def test_csv_quote(value, raw, quoted):
    assert value(text.csv_quote(F.col("t")), t=raw) == quoted


def test_page_list_skips_bad_items(value):
    assert text.parse_page_list("1, 3,x, ,5,-2") == [1, 3, 5]
    assert value(text.parse_page_list_column(F.col("t")), t="1, 3,x, ,5,-2") == [1, 3, 5]


def test_small_scalars(value):
    assert value(text.megabytes(F.col("n")), n=3 * 1024 * 1024) == "3.00 MB"
    assert value(text.keep_smaller(F.lit("abc"), F.col("t")), t="abc") == "abc"
    assert value(text.keep_smaller(F.lit("ab"), F.col("t")), t="abc") == "ab"
    assert value(text.safe_file_name(F.col("t")), t='a/b:c?"d') == "a_b_c__d"
    assert value(text.ink_share(F.col("t")), t="a b ") == 0.5


@pytest.mark.parametrize(("level", "pair"), [(0, (90, 100)), (1, (90, 100)), (5, (54, 73)), (9, (18, 45)), (12, (18, 45))])
def test_levels_round_half_away(value, level, pair):
    quality, scale = level_settings(F.col("n"))
    assert value(F.array(quality, scale), n=level) == list(pair)


@pytest.mark.parametrize("size", [0, 1, 2, 255, 256, 257, 700])
def test_prefix_sums(value, size):
    rng = random.Random(size)
    numbers = [rng.randrange(10) for _ in range(size)]
    got = value(expr.prefix_sums(F.from_json(F.col("t"), "array<int>")), t=str(numbers))
    assert got == [sum(numbers[:i]) for i in range(size)]


def test_glyph_range_equals_glyph_by_glyph(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(400):
        adv = rng.choice([6.0, 0.1, 3.3, 5.0])
        x, n = rng.choice([0.0, 24.0, 0.3]), rng.randrange(0, 30)
        left = x + adv * rng.choice([rng.randrange(-5, 35), rng.uniform(-5, 35)])
        cases.append((x, adv, n, left, left + rng.choice([adv * rng.randrange(1, 9), rng.uniform(0.01, 50)])))
    df = spark.createDataFrame(cases, "x double, adv double, n int, l double, r double")
    cols = [F.col(c) for c in ("x", "adv", "n", "l", "r")]
    for x, adv, n, left, right, got in df.select("*", geometry.glyph_range(*cols)).collect():
        hit = [i for i in range(n) if x + i * adv < right and x + (i + 1) * adv > left]
        assert list(range(got.lo, got.hi)) == hit, (x, adv, n, left, right)


def test_corners_to_area(value):
    args = [F.lit(v) for v in (300.0, 200.0, 150.0, 50.0, 1650.0)]
    area = value(geometry.corners_to_area(*args, dpi=150.0))
    assert (area.x, area.y, area.width, area.height) == pytest.approx((72.0, 696.0, 72.0, 72.0))
    thin = [F.lit(v) for v in (1.0, 1.0, 2.0, 50.0, 1650.0)]
    assert value(geometry.corners_to_area(*thin, dpi=150.0)) is None


def test_affine(value):
    shift = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 5, 7)])
    double = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 2, 0, 0)])
    point = value(geometry.affine_apply(geometry.affine_compose(shift, double), F.lit(1.0), F.lit(1.0)))
    assert (point.x, point.y) == (12.0, 16.0)


def test_patterns_are_checked_at_plan_time(spark):
    named = patterns.compile_patterns(["email", "ssn"])
    assert re.search(named[0].source, "contact me at a.b+c@example.co.uk please")
    assert not re.search(named[0].source, "not an email at all")
    literal = patterns.compile_patterns(["text:a.b (co)"])[0]
    assert re.search(literal.source, "contact a.b (co) today") and not re.search(literal.source, "contact axb (co)")
    for bad in ("not_a_real_pattern", "regex:(unclosed", "regex:a(?=b)", r"regex:(a)\1", "regex:(?<!a)b", "regex:a++", "regex:(?>a)", "regex:[[:nope:]]", "regex:(?U)a"):
        with pytest.raises(ValueError, match="pattern"):
            patterns.compile_patterns([bad])


def _ranges(spark, texts, given):
    pattern = patterns.compile_patterns([given])[0]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [[(r.lo, r.hi) for r in row[0]] for row in df.select(patterns.match_ranges(F.col("t"), pattern)).collect()]


def test_match_ranges_against_plain_search(spark):
    rng = random.Random(3)
    alphabet = "1234567890 -.()+a@b\u0001\u0002é\U0001f600\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    texts += ["", "12345678901234567890", "a@b.co", "x 123-45-6789 y 987-65-4321"]
    for given in ("email", "ssn", "phone_us", "credit_card", r"regex:\d{2}", "text:a@", "regex:x*", r"regex:\bx*", "regex:(1|2)(3)?"):
        source = patterns.compile_patterns([given])[0].source
        checked = texts + ["axxbx", "ax\u0001xx\u0002b"]
        want = [[m.span() for m in re.finditer(source, t) if m.group()] for t in checked]
        assert _ranges(spark, checked, given) == want, given


def test_user_patterns_as_written(spark):
    cases = {
        "regex:(?i)secret": ("a SECRET b", [(2, 8)]),
        "regex:(?i)\u00e9t\u00e9": ("\u00c9T\u00c9", [(0, 3)]),
        r"regex:\p{L}+": ("12 \u00e9a", [(3, 5)]),
        r"regex:(?<first_name>Bob|Al)": ("Bob", [(0, 3)]),
        r"regex:(?P<n>x)y": ("axy", [(1, 3)]),
        "regex:a(?i)b": ("aB", [(0, 2)]),
        "regex:b.c": ("b\rc", [(0, 3)]),
        "regex:end$": ("end\r", []),
        "regex:ends?$": ("end\n", []),
        "regex:(?m)end$": ("end\nend", [(0, 3), (4, 7)]),
        "regex:[[:alpha:]]+": ("1a:b\u00e9", [(1, 2), (3, 4)]),
        "regex:[[:^digit:]x]": ("1a", [(1, 2)]),
        r"regex:a\\1": ("a\\1", [(0, 3)]),
        "regex:[]a]+": ("x]a", [(1, 3)]),
        r"regex:\p{L}+?b": ("aab", [(0, 3)]),
        "text:a.b (co)": ("a.b (co) axb", [(0, 8)]),
    }
    for given, (text, want) in cases.items():
        assert _ranges(spark, [text], given) == [want], given


def test_digits_of_any_script(spark):
    assert _ranges(spark, ["١٢٣-٤٥-٦٧٨٩"], "ssn") == [[(0, 11)]]


def test_longer_digit_runs_match_without_word_bounds(spark):
    assert _ranges(spark, ["99" + "1" * 16], "credit_card") == [[(0, 16)]]


def test_masks_see_the_original_text(value):
    both = patterns.compile_patterns([r"regex:\d{3}", "regex:3-4", "email"])
    assert value(patterns.blank_all(F.col("t"), both), t="a123-456b x@y.zz") == "a       b       "


def test_masks_keep_marks_in_the_text(value):
    for given, want in (("regex:x*", "a \u0001  \u0002b"), ("regex:x+", "a \u0001  \u0002b")):
        one = patterns.compile_patterns([given])
        assert value(patterns.blank_all(F.col("t"), one), t="ax\u0001xx\u0002b") == want


@pytest.mark.parametrize("plain", ["", "ASCII only", "é", "多 \U0001f600"])
def test_text_survives_encoding(value, plain):
    assert value(text.decode_text(text.encode_text(F.col("t"))), t=plain) == plain


def test_decoding(value):
    assert value(text.decode_text(F.col("b")), b=bytearray(b"caf\xe9")) == "café"
    assert value(text.decode_text(F.col("b")), b=bytearray(b"\xfe\xff\x00a\x20\xac")) == "a€"
    assert bytes(value(text.encode_text(F.col("t")), t="é")) == b"\xfe\xff\x00\xe9"
    assert value(text.decode_lossy(F.col("b")), b=bytearray(b"ok\xff!")) == "ok\ufffd!"
