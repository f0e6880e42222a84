"""Coercion, normalisation, ids and hashes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str | float | int) -> Column:
    """A column by name, a literal by value."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


_c = as_column


def to_string(x: Column | str) -> Column:
    """FN-25. Trimmed; empty is null."""
    t = F.trim(_c(x).cast("string"))
    return F.when(t != "", t)


def to_long(x: Column | str) -> Column:
    """FN-25. From text: whole numbers, or decimals cut to whole ones; anything else, NaN and infinities are null."""
    t = F.trim(_c(x).cast("string"))
    return F.coalesce(t.try_cast("long"), F.when(~F.isnan(t.try_cast("double")) & (F.abs(t.try_cast("double")) < 9e18), t.try_cast("double").try_cast("long")))


def to_double(x: Column | str) -> Column:
    """FN-25. NaN and infinities are null."""
    d = F.trim(_c(x).cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def to_boolean(x: Column | str) -> Column:
    """FN-25. true/false, yes/no and 1/0 in any case."""
    t = F.lower(F.trim(_c(x).cast("string")))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def literal_map(values: Mapping[str, object]) -> Column:
    """A map column from a small fixed table."""
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))


def alias(x: Column | str, aliases: Mapping[str, str]) -> Column:
    """PRJ-04. Upper-cased and trimmed, then through the alias table, itself if it isn't there."""
    key = F.upper(F.trim(_c(x)))
    return F.coalesce(F.element_at(literal_map(aliases), key), key) if aliases else key


def strict_recode(x: Column | str, values: Mapping[str, object], null: object = None) -> Column:
    """PRJ-03. value to code; a null gives `null`, a value that is not in the table is an error."""
    found = F.element_at(literal_map(values), _c(x))
    message = F.concat(F.lit("unknown value: "), _c(x))
    return F.when(_c(x).isNull(), F.lit(null)).when(found.isNotNull(), found).otherwise(F.raise_error(message).cast("int"))


def token(x: Column | str) -> Column:
    """FN-26. Lower case, letters and digits only, one space between; accents stay."""
    t = F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "))
    return F.when(t != "", t)


#: FN-26. Accented Latin letters and their plain forms, in the order of one another. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def name_key(x: Column | str) -> Column:
    """FN-26. token() without accents and without name suffixes."""
    return F.trim(F.regexp_replace(F.translate(token(x), ACCENTED, PLAIN), r" (jr|sr|ii|iii|iv|v)$", ""))


def same_name(a: Column | str, b: Column | str) -> Column:
    """FN-26. Equality that ignores case and accents, by collation."""
    return F.collate(_c(a), "UNICODE_CI_AI") == F.collate(_c(b), "UNICODE_CI_AI")


def id_part(x: Column | str, k: int, sep: str = "_") -> Column:
    """FN-27. The k-th part (from 0) of a composite id."""
    return F.try_element_at(F.split(_c(x), sep), F.lit(k + 1))


def block_label(season: Column | str, week: Column | str) -> Column:
    """FN-27. 2024, 3 as 2024-W03."""
    return F.concat(_c(season).cast("string"), F.lit("-W"), F.lpad(_c(week).cast("string"), 2, "0"))


def joined_id(*parts: Column | str) -> Column:
    """FN-28. Parts joined by `:`, nulls as empty."""
    return F.concat_ws(":", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


def record_hash(*columns: str) -> Column:
    """FN-28, FN-33. SHA-256 of the JSON of the columns in sorted order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def ratio(a: Column | str, b: Column | str) -> Column:
    """FN-34. Null if the denominator is zero."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))
