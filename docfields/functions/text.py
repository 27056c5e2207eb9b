"""Scalar column functions (JVM-side expressions, no Python per row)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# Instruction delimiters, in priority order (the first one present wins):
INSTRUCTION_DELIMITERS = [",", ";", "\n", "-", "•"]
# Text truncation: default length and the marker appended.
TRUNCATE_DEFAULT = 100
TRUNCATE_MARKER = "..."
# Secret masking: characters kept at each end, joined by the marker.
MASK_KEEP = 10
MASK_MARKER = "..."
# Key format rule: prefix and minimum length (length must exceed 20).
KEY_PREFIX = "sk-"
KEY_MIN_LENGTH_EXCLUSIVE = 20
# Value formatting: null / true / false.
FORMAT_NULL = "N/A"
FORMAT_TRUE = "Yes"
FORMAT_FALSE = "No"
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes, spelled so that Java regex and RE2
# read it the same way (RE2's \s lacks \x0b, so it is listed explicitly).
STRIP_CLASS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = f"^{STRIP_CLASS}+|{STRIP_CLASS}+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same characters listed one by one (every character Python's
# ``str.isspace`` accepts, plus \x1c-\x1f).
STRIP_CHARS = ([chr(x) for x in range(0x09, 0x0E)] + [chr(x) for x in range(0x1C, 0x21)]
               + ["\x85", "\xa0", "\u1680"] + [chr(x) for x in range(0x2000, 0x200B)]
               + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])


def strip_text(c) -> Column:
    """Python-style ``str.strip()`` (Unicode whitespace and \x1c-\x1f).

    ``btrim`` with the character set removes those code points from both
    ends: no regex, and it stays inside whole-stage codegen. (The oracle SQL
    spells the same set as the regex ``STRIP_PATTERN``.)
    """
    return F.btrim(_col(c), F.lit("".join(STRIP_CHARS)))


def truncate_text(c, max_length: int = TRUNCATE_DEFAULT) -> Column:
    """First ``max_length`` characters plus ``...`` when longer, else unchanged."""
    c = _col(c)
    return F.when(F.length(c) > max_length,
                  F.concat(F.substring(c, 1, max_length), F.lit(TRUNCATE_MARKER))).otherwise(c)


def mask_secret(c, safe: bool = False) -> Column:
    """First 10 + ``...`` + last 10 characters.

    With ``safe=True`` keys shorter than 24 characters (where the two ends
    would overlap and reveal the whole key) are masked completely.
    """
    c = _col(c)
    masked = F.concat(F.substring(c, 1, MASK_KEEP), F.lit(MASK_MARKER), F.right(c, F.lit(MASK_KEEP)))
    if safe:
        return F.when(F.length(c) < 2 * MASK_KEEP + len(MASK_MARKER) + 1, F.lit("*" * 3)).otherwise(masked)
    return masked


def key_format_check(c) -> Column:
    """True when the value starts with ``sk-`` and is longer than 20; null/empty -> false."""
    c = _col(c)
    return F.coalesce(c.startswith(KEY_PREFIX) & (F.length(c) > KEY_MIN_LENGTH_EXCLUSIVE), F.lit(False))


def format_timestamp(c) -> Column:
    """ISO-8601 text like Python ``isoformat()``: the fraction is dropped when zero."""
    c = _col(c)
    micros = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, base).otherwise(
        F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


_SPLITTER = 134217729.0  # 2**27 + 1: splits a double into two 26-bit halves


def format_fixed(c, decimals: int = 2) -> Column:
    """Python's ``format(x, '.<d>f')`` natively: the exact binary value is
    rounded half-to-even, as Python does (2.675 -> ``2.67``, 0.125 ->
    ``0.12``, 1.005 -> ``1.00``); Java's ``%.<d>f`` (``format_string``) rounds
    the shortest decimal text half-up instead (``2.68``, ``0.13``, ``1.01``).

    |x| = i + f with i = floor(|x|) and f exact; f·10^d is computed together
    with its exact rounding error (Dekker's error-free product: only double
    arithmetic, which Catalyst does not reassociate), which decides exact
    ties. Sign kept for negatives that round to zero and for -0.0; ``nan``,
    ``inf``, ``-inf`` as Python writes them; null stays null. Whole numbers
    beyond a bigint are put together from three exact parts; from 1e38 on, which
    no native decimal holds, Java's formatting gives zeros past the 17th digit.
    """
    if not 0 <= decimals <= 7:
        raise ValueError("decimals must be in 0..7")
    x = _col(c).cast("double")
    scale = float(10 ** decimals)
    a = F.abs(x)
    i = F.floor(a).cast("double")
    f = a - i                                   # exact
    p = f * F.lit(scale)                        # rounded product, < 10**d
    t = f * F.lit(_SPLITTER)
    fh = t - (t - f)
    fl = f - fh
    err = (fh * F.lit(scale) - p) + fl * F.lit(scale)   # f*scale == p + err exactly
    k = F.floor(p).cast("double")
    r = p - k                                   # exact
    last = k if decimals else i                 # the digit a half-even tie keeps even
    up = (F.when(r > 0.5, True).when(r < 0.5, False)
           .when(err > 0, True).when(err < 0, False)
           .otherwise(F.pmod(last, F.lit(2.0)) == 1.0))
    units = k + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))
    carry = units >= F.lit(scale)
    frac = F.when(carry, F.lit(0.0)).otherwise(units)
    whole = i + F.when(carry, F.lit(1.0)).otherwise(F.lit(0.0))
    whole_txt = whole.cast("bigint").cast("string")
    body = whole_txt if decimals == 0 else F.concat(
        whole_txt, F.lit("."), F.lpad(frac.cast("bigint").cast("string"), decimals, "0"))
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when(F.isnan(x), F.lit("nan"))
             .when(x == float("inf"), F.lit("inf"))
             .when(x == float("-inf"), F.lit("-inf"))
             .when(a >= F.lit(1e38), F.format_string(f"%.{decimals}f", x))
             .when(a >= F.lit(9.2e18), F.concat(sign, _whole_digits(a), F.lit("." + "0" * decimals if decimals else "")))
             .otherwise(F.concat(sign, body)))


def _whole_digits(a: Column) -> Column:
    """Exact digits of a whole double below 1e38: its parts of 40 bits are exact
    doubles, their weights exact decimals."""
    a = F.when(a < F.lit(1e38), a).otherwise(F.lit(0.0))
    high = F.floor(a / F.lit(2.0 ** 80)).cast("double")
    rest = a - high * F.lit(2.0 ** 80)
    middle = F.floor(rest / F.lit(2.0 ** 40)).cast("double")
    low = rest - middle * F.lit(2.0 ** 40)
    parts = [p.cast("bigint").cast("decimal(19,0)") for p in (high, middle, low)]
    weights = [F.lit(Decimal(2) ** n) for n in (80, 40, 0)]
    return sum((p * w for p, w in zip(parts[1:], weights[1:], strict=True)), parts[0] * weights[0]).cast("decimal(38,0)").cast("string")


def format_currency(c) -> Column:
    """``$`` + two decimals, no thousands separator; negatives as ``$-x``."""
    return F.concat(F.lit("$"), format_fixed(c, 2))


def format_decimal2(c) -> Column:
    """Two-decimal text (Python ``"{:.2f}"``)."""
    return format_fixed(c, 2)


def abs_error(observed, predicted) -> Column:
    return F.abs(_col(observed) - _col(predicted))


def _split_literal(c: Column, delim: str) -> Column:
    # split() takes a Java regex; all delimiters are quoted to be literal.
    return F.split(c, "\\Q" + delim + "\\E", -1)


def split_instructions(c) -> Column:
    """Instruction text -> ordered field list.

    The first delimiter present (``, ; newline - •`` in that order) splits the
    text; without a delimiter the whole text is one field. Fields are stripped
    and empty ones dropped, so ``""`` and ``",,"`` give ``[]``.
    """
    c = _col(c)
    expr = None
    for d in INSTRUCTION_DELIMITERS:
        cond = F.instr(c, d) > 0
        expr = F.when(cond, _split_literal(c, d)) if expr is None else expr.when(cond, _split_literal(c, d))
    parts = expr.otherwise(F.array(c))
    return F.filter(F.transform(parts, strip_text), lambda x: x != F.lit(""))


def parse_instructions(instructions: str) -> list[str]:
    """Driver-side form of :func:`split_instructions` for a parameter string."""
    delim = next((d for d in INSTRUCTION_DELIMITERS if d in instructions), None)
    parts = instructions.split(delim) if delim is not None else [instructions]
    return [p.strip() for p in parts if p.strip()]


def format_value(value_col, type_col) -> Column:
    """Display text of a JSON value given its kind (see ``results.value_kind``).

    null -> ``N/A``; boolean -> ``Yes``/``No``; array/object -> compact JSON;
    anything else -> stripped text.
    """
    v, t = _col(value_col), _col(type_col)
    return (F.when(t.isNull() | (t == "null") | v.isNull(), F.lit(FORMAT_NULL))
             .when(t == "boolean", F.when(v == "true", F.lit(FORMAT_TRUE)).otherwise(F.lit(FORMAT_FALSE)))
             .when(t.isin("array", "object"), v)
             .otherwise(strip_text(v)))


def size_mb(length_col) -> Column:
    """Bytes -> megabytes (2**20), as a double."""
    return _col(length_col) / F.lit(1048576.0)


def file_stem(path_col) -> Column:
    """Last path segment without its final extension (``a/b.tar.gz`` -> ``b.tar``)."""
    name = F.element_at(F.split(_col(path_col), "/", -1), -1)
    return F.regexp_replace(name, r"^(.+)[.][^.]*$", "$1")


def output_name(path_col, prefix: str = "extracted_", suffix: str = ".csv") -> Column:
    return F.concat(F.lit(prefix), file_stem(path_col), F.lit(suffix))
