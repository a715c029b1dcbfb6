"""Oracle SQL fragments shared by the query modules (DuckDB spelling)."""

# Python's str.strip() whitespace, spelled for RE2.
PY_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def py_nonblank(x: str) -> str:
    return f"coalesce(length({strip(x)}) > 0, false)"


def sql_nonblank(x: str) -> str:
    return f"({x} IS NOT NULL AND length(trim({x})) > 0)"


IN_CITY = "(s.address LIKE '%台北市%' OR s.address LIKE '%臺北市%')"
DISTRICT_RE = "(?:台北市|臺北市).*?([\\x{4e00}-\\x{9fff}]{1,4}區)"


def district(x: str) -> str:
    return (f"CASE WHEN regexp_extract(coalesce({x}, ''), '{DISTRICT_RE}', 1) = '' THEN '未辨識行政區' "
            f"ELSE regexp_extract(coalesce({x}, ''), '{DISTRICT_RE}', 1) END")


def has_scores(a: str, b: str, ta: str, tb: str, r: str) -> str:
    return (f"(coalesce(CAST({a} AS DOUBLE), 0) > 0 OR coalesce(CAST({b} AS DOUBLE), 0) > 0 OR "
            f"{py_nonblank(ta)} OR {py_nonblank(tb)} OR {py_nonblank(r)})")
