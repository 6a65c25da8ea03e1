"""Scalar functions: vocabulary lookups, globs, tokens, signs, verdicts. All are Catalyst expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NT_ALIASES, NT_CLASSES, NT_INHIBITORY, NT_UNKNOWN, SIDES, SUPER_CLASSES


def lookup(table: Mapping, key: Column) -> Column:
    """Value of ``key`` in a literal map, null if absent."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def normalize_nt(raw: Column) -> Column:
    """Canonical transmitter; unknown spellings of "unknown" are null, any other label is an error."""
    key = F.lower(F.trim(raw))
    found = lookup(NT_ALIASES, key)
    return F.when(raw.isNull() | key.isin(*NT_UNKNOWN), F.lit(None).cast("string")).when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unrecognised neurotransmitter label "), raw)))


def normalize_super_class(source: str, raw: Column) -> Column:
    """Exact, then lower-case lookup, else the trimmed value; empty is null."""
    if source not in SUPER_CLASSES:
        raise KeyError(f"unknown super_class source {source!r}; known: {sorted(SUPER_CLASSES)}")
    key = F.nullif(F.trim(raw), F.lit(""))
    return F.coalesce(lookup(SUPER_CLASSES[source], key), lookup(SUPER_CLASSES[source], F.lower(key)), key)


def normalize_side(raw: Column) -> Column:
    return lookup(SIDES, F.lower(F.trim(raw)))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a case-sensitive glob (``*``, ``?``, ``[abc]``, ``[!a]``)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negate = body.startswith("!")
            body = (body[1:] if negate else body).replace("\\", "\\\\").replace("^", "\\^").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^' * negate}{body}]")
            i = end
        elif c in r"\.^$|()+{}[]":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob_match(value: Column, pattern: str) -> Column:
    """True where the value, as text, matches; null never does."""
    return F.coalesce(value.cast("string").rlike(glob_regex(pattern)), F.lit(False))


def tokens(value: Column, separators: str = ",") -> Column:
    """Trimmed non-empty parts of a list in text."""
    return F.filter(F.transform(F.split(value, f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")


def published_name(name: Column) -> Column:
    """``a:b:c`` as a struct (kind, library, name); anything else is ("line", "", name)."""
    parts = F.split(name, ":")
    three = F.size(parts) == 3
    return F.struct(
        F.when(three, F.get(parts, F.lit(0))).otherwise("line").alias("kind"),
        F.when(three, F.get(parts, F.lit(1))).otherwise("").alias("library"),
        F.when(three, F.get(parts, F.lit(2))).otherwise(name).alias("name"),
    )


def sign_table(overrides: Mapping[str, int] | None = None) -> dict[str, int]:
    """Sign of each transmitter: -1 for inhibitory ones, else 1; overrides are checked."""
    table = {nt: -1 if nt in NT_INHIBITORY else 1 for nt in NT_CLASSES}
    for nt, sign in (overrides or {}).items():
        if nt not in table:
            raise KeyError(f"unknown transmitter {nt!r}; known: {NT_CLASSES}")
        if sign not in (-1, 1):
            raise ValueError(f"sign override for {nt!r} must be -1 or 1, got {sign!r}")
        table[nt] = int(sign)
    return table


def cosine(dot: Column, uu: Column, vv: Column) -> Column:
    """Cosine from a dot product and two squared norms; 0 where a norm is 0."""
    norm = F.sqrt(uu) * F.sqrt(vv)
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def size_bin(n: Column) -> Column:
    """1 up to 1, else the power of two nearest in log (half to even)."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2), F.bround(F.log2(n), 0))).cast("long")


def hash_uniform(*key: Column) -> Column:
    """A uniform number in [0, 1) that SQL engines agree on: the first 32 bits of an MD5 digest."""
    text = F.concat_ws(":", *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def verdict(p: Column, statistic: Column, *, alpha: float = 0.05, low: float = 0.045, band: float = 0.096) -> Column:
    """Three grades of a comparison: not distinguishable (also if the statistic is not positive), within the usual
    range between brains, or beyond it."""
    return F.when((p >= alpha) | (statistic <= 0), "not distinguishable").when(statistic <= low + band, "differs within the usual range").otherwise("differs")


def variant_label(reference: Column, difference: Column, low: Column, high: Column) -> Column:
    """holds (interval excludes 0, same sign as the reference), flips (other sign) or weakens; an error if the
    reference is 0."""
    excludes = (low > 0) | (high < 0)
    same = F.signum(reference) == F.signum(difference)
    return F.when(reference == 0, F.raise_error(F.lit("the reference effect is 0"))).when(excludes & same, "holds").when(excludes, "flips").otherwise("weakens")


def axis_outcome(n: Column, holds: Column, *, sampled: bool) -> Column:
    """pass if all variants hold; sampled axes need three quarters, rounded up."""
    need = F.ceil(n * 0.75) if sampled else n
    return F.when(n == 0, F.lit(None).cast("string")).when(holds >= need, "pass").otherwise("fail")


def tier(n_axes: Column, n_failed: Column) -> Column:
    """Strong without failures, Conditional with one, else Fragile; thin with fewer than two axes."""
    grade = F.when(n_failed == 0, "Strong").when(n_failed == 1, "Conditional").otherwise("Fragile")
    return F.when(n_axes < 2, F.concat(grade, F.lit(" (thin)"))).otherwise(grade)


def null_p(n_as_extreme: Column, n: Column) -> Column:
    return (1 + n_as_extreme) / (n + 1)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def params_hash(params: object, digits: int = 16) -> str:
    """SHA-256 over sorted JSON."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:digits]
