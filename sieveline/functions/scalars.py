"""Scalar expressions on text, as Spark SQL: strip, normalize, parse numbers and dates, digest."""

from __future__ import annotations

from sieveline.functions.columns import text
from sieveline.functions.fixed import CHARS_PER_TOKEN, WHITESPACE

# The characters of WHITESPACE, as ranges. Possessive quantifiers keep cells that do not match cheap.
_SPACES = r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*+"
_DECIMAL = r"(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"
_NUMBER = rf"^{_SPACES}([+-]?(?:{_DECIMAL}|(?i:inf|infinity))){_SPACES}$"

# Layouts of dates, with the years a nanosecond timestamp can hold. A time part may follow the date.
_YEAR = r"(?:167[7-9]|16[89][0-9]|1[7-9][0-9]{2}|2[01][0-9]{2}|22[0-5][0-9]|226[0-2])"
_ISO = rf"^{_SPACES}{_YEAR}(?:{_SPACES}$|-[0-9]{{1,2}}(?:{_SPACES}$|-[0-9]{{1,2}}(?:{_SPACES}$|[ T][0-9])))"
_COMPACT = rf"^{_SPACES}({_YEAR})([0-9]{{2}})([0-9]{{2}}){_SPACES}$"
_SLASHED = rf"^{_SPACES}([0-9]{{1,2}})[/.-]([0-9]{{1,2}})[/.-]({_YEAR})((?:[ T][0-9:.]+)?){_SPACES}$"
_NAMED = rf"^{_SPACES}([A-Za-z]{{3}} [0-9]{{1,2}}, {_YEAR}){_SPACES}$"

KEY_BYTES = 64


def strip(value: str) -> str:
    """Without leading and trailing Unicode whitespace; inner text stays."""
    return f"trim(BOTH {text(WHITESPACE)} FROM {value})"


def normalize(value: str, case: bool = True, whitespace: bool = True) -> str:
    if whitespace:
        value = strip(value)
    return f"lower({value})" if case else value


def parse_number(value: str) -> str:
    """Text as double; NULL where it is no plain decimal number or infinity, or overflows.

    The pattern comes first: a bare cast also takes ``1d`` and ``nan``, and it throws and
    catches a Java exception for every cell that is no number.
    """
    pattern = text(_NUMBER)
    parsed = f"try_cast(regexp_extract({value}, {pattern}, 1) AS DOUBLE)"
    overflow = f"abs({parsed}) = double('Infinity') AND {value} RLIKE '[0-9]'"
    return f"CASE WHEN {value} RLIKE {pattern} AND NOT ({overflow}) THEN {parsed} END"


def parse_timestamp(value: str) -> str:
    """Text as a timestamp without time zone; NULL where no known date layout fits.

    Layouts: ISO dates with optional time, compact ``yyyyMMdd``, ``M/d/yyyy`` (month first, day
    first where the month would be over 12) with optional time, and ``Mon d, yyyy``. Years run from
    1677 to 2262, the range of nanosecond timestamps. Numeric layouts are rewritten to ISO text,
    so that one cast per cell does the work and failing cells raise nothing.
    """
    def rewritten(pattern: str, template: str) -> str:
        return f"try_cast(regexp_replace({value}, {text(pattern)}, '{template}') AS TIMESTAMP_NTZ)"

    named = f"initcap(regexp_extract({value}, {text(_NAMED)}, 1))"
    return (
        f"CASE WHEN {value} RLIKE {text(_ISO)} THEN try_cast({strip(value)} AS TIMESTAMP_NTZ) "
        f"WHEN {value} RLIKE {text(_COMPACT)} THEN {rewritten(_COMPACT, '$1-$2-$3')} "
        f"WHEN {value} RLIKE {text(_SLASHED)} THEN "
        f"coalesce({rewritten(_SLASHED, '$3-$1-$2$4')}, {rewritten(_SLASHED, '$3-$2-$1$4')}) "
        f"WHEN {value} RLIKE {text(_NAMED)} THEN CAST(try_to_date({named}, 'MMM d, yyyy') AS TIMESTAMP_NTZ) END"
    )


def short_key(value: str) -> str:
    """A stand-in that is equal exactly when the text is equal, and short enough to shuffle.

    Texts up to 64 bytes stand for themselves; longer ones become their SHA-256 digest under a
    prefix that makes the key longer than any text kept as is.
    """
    return f"if(octet_length({value}) <= {KEY_BYTES}, {value}, concat('sha-256:', sha2({value}, 256)))"


def estimate_tokens(value: str) -> str:
    """Token estimate of a text: characters / 3.5 rounded up, 0 for empty or missing text."""
    return f"CAST(coalesce(ceil(char_length({value}) / {CHARS_PER_TOKEN}D), 0) AS BIGINT)"


def prompt_key(value: str) -> str:
    """SHA-256 of the prompt text, in hex."""
    return f"sha2({value}, 256)"
