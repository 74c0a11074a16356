"""Text derivations: event descriptions, stripping, truncation, display names, formatting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: Unicode White_Space plus the separators \x1c-\x1f.
_WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{_WS}+|{_WS}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Unicode-aware strip (Spark's trim only removes spaces)."""
    return F.regexp_replace(_c(c), _STRIP_RE, "")


def event_description(description="description", screen="screen_name",
                      application="application_name") -> Column:
    """'{description} in the screen {screen} of the application {application}'; null cells print None."""
    return F.concat(F.coalesce(_c(description), F.lit("None")), F.lit(" in the screen "),
                    F.coalesce(_c(screen), F.lit("None")), F.lit(" of the application "),
                    F.coalesce(_c(application), F.lit("None")))


def event_text_strict(description="description", screen="screen_name",
                      application="application_name") -> Column:
    """Same sentence, but null if any part is null (the embedding notebook's variant)."""
    return F.concat(_c(description), F.lit(" in the screen "), _c(screen),
                    F.lit(" of the application "), _c(application))


def truncate_label(c, n: int = 20, suffix: str = "...") -> Column:
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def capitalize(c) -> Column:
    """Python str.capitalize: first character upper, the rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def capitalize_words(c, sep: str = "_") -> Column:
    """' '.join(p.capitalize() for p in c.split(sep))."""
    return F.array_join(F.transform(F.split(_c(c), sep, -1), capitalize), " ")


# Display names for known models and domains.
DISPLAY_NAME_MAP = {
    "gpt-4.1": "GPT-4.1",
    "claude-3.5-haiku": "Claude-3.5-Haiku",
    "deepseek-r1": "DeepSeek-R1",
    "Qwen3-32B": "Qwen3-32B",
    "gemini-2.5-flash": "Gemini-2.5-Flash",
    "hr": "HR",
}


def display_name(c, known_domains: Iterable[str] = (),
                 mapping: Mapping[str, str] = DISPLAY_NAME_MAP) -> Column:
    """Map lookup; else 'dom_a_b' -> 'Dom - A B' when 'dom' is a known domain or mapped name;
    else 'a_b' -> 'A B'; else capitalize."""
    c = _c(c)
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) \
        if mapping else F.create_map().cast("map<string,string>")
    known = sorted(set(known_domains) | set(mapping))
    head = F.substring_index(c, "_", 1)
    rest = F.regexp_replace(c, "^[^_]*_", "")
    head_disp = F.coalesce(F.element_at(m, head), capitalize(head))
    return (F.when(F.element_at(m, c).isNotNull(), F.element_at(m, c))
            .when(c.contains("_") & head.isin(known),
                  F.concat(head_disp, F.lit(" - "), capitalize_words(rest)))
            .when(c.contains("_"), capitalize_words(c))
            .otherwise(capitalize(c)))


def fmt_percent(c, decimals: int = 1) -> Column:
    """Python '{:.1%}'."""
    return F.format_string(f"%.{decimals}f%%", _c(c) * 100)


def fmt_fixed(c, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", _c(c))


def fmt_count(c) -> Column:
    """Thousands separators, e.g. 12,345."""
    return F.format_number(_c(c).cast("bigint"), 0)


def safe_div(num, den) -> Column:
    """num / den, 0 when den is 0 or null (zero_division=0)."""
    num, den = _c(num), _c(den)
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


def f1(p, r) -> Column:
    p, r = _c(p), _c(r)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
