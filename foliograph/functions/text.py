"""Edit distance, closest match, and formatting and parsing of sizes and durations.

Formatting takes style "es" (1.234,5) or "en" (1,234.5). Everything but the edit
distance is a JVM expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Decimal and binary units, and words for yes and no.
UNITS = ("KB", "MB", "GB", "TB", "PB")
SIZE_UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "ki": 1 << 10, "kib": 1 << 10, "mi": 1 << 20, "mib": 1 << 20, "gi": 1 << 30, "gib": 1 << 30}
YES, NO = ("", "1", "true", "t", "si", "sí", "s", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def osa_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, without case; no
    part of a word is edited twice (optimal string alignment)."""
    a, b = a.lower(), b.lower()
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            d = min(one[j + 1] + 1, row[j] + 1, one[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, two[j - 1] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def _letters(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = [ord(c) for c in w]
    return out


def osa_distances(a: list[str], b: list[str]) -> np.ndarray:
    """osa_distance of each pair, a column of the table at a time for all pairs at once."""
    a, b = [x.lower() for x in a], [y.lower() for y in b]
    la, lb = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    x, y = _letters(a, max(la, default=0)), _letters(b, max(lb, default=0))
    out = np.where(la == 0, lb, 0)
    two, one = None, np.tile(np.arange(y.shape[1] + 1), (len(a), 1))
    for i in range(x.shape[1]):
        row = np.empty_like(one)
        row[:, 0] = i + 1
        for j in range(y.shape[1]):
            d = np.minimum(np.minimum(one[:, j + 1], row[:, j]) + 1, one[:, j] + (x[:, i] != y[:, j]))
            if i and j:
                swap = (x[:, i] == y[:, j - 1]) & (x[:, i - 1] == y[:, j])
                d = np.where(swap, np.minimum(d, two[:, j - 1] + 1), d)
            row[:, j + 1] = d
        out = np.where(la == i + 1, row[np.arange(len(a)), lb], out)
        two, one = one, row
    return out


@F.pandas_udf(LongType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """osa_distance for columns; a null on either side gives null."""
    full = a.notna() & b.notna()
    out = pd.Series([None] * len(a), index=a.index, dtype="Int64")
    rows = np.flatnonzero(full.to_numpy())
    for at in range(0, len(rows), 2000):  # words of like lengths share a table
        some = rows[at : at + 2000]
        out.iloc[some] = osa_distances(a.iloc[some].tolist(), b.iloc[some].tolist())
    return out


def closest(word: str, candidates: list[str]) -> str:
    """The first nearest candidate, if a third of the word's letters (at least one) is
    the most that differs; else an empty string."""
    found = min(((osa_distance(word, c), k) for k, c in enumerate(candidates)), default=None)
    return candidates[found[1]] if found and found[0] <= max(1, len(word) // 3) else ""


def closest_match(df: DataFrame, word: str, candidates: DataFrame) -> DataFrame:
    """Add closest. candidates: (ord, name), any number of them.

    Distances are at least the difference of lengths, so distinct words meet only the
    candidates whose length is within their bound, by an equality join on lengths, and
    of those the nearest, then the first, is kept by an aggregation.
    """
    words = df.select(F.col(word).alias("word_")).distinct().withColumn("most", F.greatest(F.lit(1), F.floor(F.length("word_") / 3)).cast("int"))
    spread = words.where("word_ is not null").withColumn("letters", F.explode(F.sequence(F.length("word_") - F.col("most"), F.length("word_") + F.col("most"))))
    names = candidates.select("ord", "name", F.length("name").alias("letters"))
    near = spread.join(names, "letters").withColumn("distance", osa(F.col("word_"), F.col("name"))).where("distance <= most")
    best = near.groupBy("word_").agg(F.min(F.struct("distance", "ord", "name")).alias("x")).select("word_", F.col("x.name").alias("closest"))
    told = words.select("word_").join(best, "word_", "left").withColumn("closest", F.when(F.col("word_").isNotNull(), F.coalesce("closest", F.lit(""))))
    return df.join(told, F.col(word).eqNullSafe(F.col("word_"))).drop("word_")


def grouped(n: Column, style: str = "es") -> Column:
    """A whole number with its thousands apart."""
    plain = F.format_string("%,d", n.cast("long"))
    return F.translate(plain, ",", ".") if style == "es" else plain


def _let(value: Column, told: Callable[[Column], Column]) -> Column:
    """told(value), with the value computed once and named once in the expression."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def fixed(x: Column, places: int, style: str = "es") -> Column:
    """A number with so many decimals (2 at most); a zero has no sign.

    The double's exact value is rounded, a tie to the even digit: its fraction counts
    2**-53 parts, and those times a power of ten are whole numbers.
    """
    if not 0 <= places <= 2:
        raise ValueError("0, 1 or 2 decimals")
    scale, half = 10**places, F.lit(1 << 52)

    def rounded(size: Column) -> Column:
        """The number times the scale, as a long."""
        whole, parts = F.floor(size).cast("long"), (size - F.floor(size)) * float(1 << 53)
        held = F.floor(parts).cast("long") * scale
        below, rest = whole * scale + F.shiftright(held, 53), held.bitwiseAND(F.lit((1 << 53) - 1))
        up = (rest > half) | ((rest == half) & ((parts != F.floor(parts)) | (below % 2 == 1)))
        return below + up.cast("long")

    def shown(told: Column) -> Column:
        plain = F.format_string("%,d", ((told - told % scale) / scale).cast("long"))
        return F.concat(plain, F.lit("."), F.lpad((told % scale).cast("string"), places, "0")) if places else plain

    def signed(plain: Column) -> Column:
        return F.when((x.cast("double") < 0) & plain.rlike("[1-9]"), F.concat(F.lit("-"), plain)).otherwise(plain)

    def text(size: Column) -> Column:  # beyond 1e13 no fraction counts
        return F.when(size < 1e13, _let(rounded(size), shown)).otherwise(F.format_string(f"%,.{places}f", size))

    plain = _let(_let(F.abs(x.cast("double")), text), signed)
    plain = F.when(x.isNotNull(), plain)
    return F.translate(plain, ",.", ".,") if style == "es" else plain


def three_digits(x: Column, style: str = "es") -> Column:
    """Two decimals below 10, one below 100, else none."""
    return F.when(x < 10, fixed(x, 2, style)).when(x < 100, fixed(x, 1, style)).otherwise(fixed(x, 0, style))


def format_bytes(n: Column, style: str = "es", last: str = "PB", apart: bool = True) -> Column:
    """Decimal units up to last and about three digits. Beyond 999 of the last unit
    there are more; apart says whether their thousands are."""
    size = F.abs(n.cast("double"))
    out = F.when(size < 1000, F.concat(grouped(size, style), F.lit(" B")))
    for k, unit in enumerate(UNITS[: UNITS.index(last) + 1]):
        v = size / float(1000 ** (k + 1))
        text = F.concat(three_digits(v, style), F.lit(f" {unit}"))
        if unit == last and not apart:
            text = F.translate(text, "." if style == "es" else ",", "")
        out = out.otherwise(text) if unit == last else out.when(v < 999.5, text)
    return F.concat(F.when(n < 0, "-").otherwise(""), out)


def _pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def format_duration(seconds: Column, style: str = "es") -> Column:
    """Milliseconds, seconds of three digits, minutes or hours: 87 ms, 5,31 s, 6 min 02 s."""
    s = F.abs(seconds.cast("double"))
    whole = F.floor(s).cast("long")
    minutes, hours = F.floor(whole / 60).cast("long"), F.floor(whole / 3600).cast("long")
    out = (
        F.when(s < 0.001, F.concat(fixed(s * 1000, 2, style), F.lit(" ms")))
        .when(s < 1, F.concat(F.floor(s * 1000).cast("string"), F.lit(" ms")))
        .when(s < 60, F.concat(three_digits(s, style), F.lit(" s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit(" min "), _pad(whole % 60), F.lit(" s")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h "), _pad(minutes % 60), F.lit(" min")))
    )
    return F.concat(F.when(seconds < 0, "-").otherwise(""), out)


def format_clock(seconds: Column) -> Column:
    """Minutes and seconds, with hours in front if there are any; negative times are 0:00."""
    t = F.floor(F.greatest(seconds.cast("double"), F.lit(0.0)) + 0.5).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor(t / 60).cast("long") % 60, t % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _pad(m), F.lit(":"), _pad(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), _pad(s)))


def format_percent(share: Column, places: int = 0, style: str = "es") -> Column:
    odd = share.isNull() | F.isnan(share.cast("double")) | (F.abs(share) == float("inf"))
    return F.when(odd, "— %").otherwise(F.concat(fixed(share * 100, places, style), F.lit(" %")))


def _ago(text: Column, style: str) -> Column:
    return F.concat(F.lit("hace "), text) if style == "es" else F.concat(text, F.lit(" ago"))


def format_ago(seconds: Column, style: str = "es", short: bool = False) -> Column:
    """How long ago, in seconds, minutes, hours or days; short keeps one unit."""
    whole = F.floor(seconds.cast("double")).cast("long")
    days = F.floor(whole / 86400).cast("string")
    middle = F.when(whole < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit(" h"))) if short else format_duration(whole, style)
    return (
        F.when(seconds.isNull(), "—")
        .when(seconds < 1, "recién" if style == "es" else "just now")
        .when(seconds < 60, _ago(F.concat(whole.cast("string"), F.lit(" s")), style))
        .when(seconds >= 48 * 3600, _ago(F.concat(days, F.lit(" días" if style == "es" else " days")), style))
        .otherwise(_ago(middle, style))
    )


def format_rate(n: Column, seconds: Column, style: str = "es") -> Column:
    return F.when(seconds > 0, F.concat(format_bytes(F.floor(n / seconds), style), F.lit("/s"))).otherwise("—")


def parse_size(text: Column) -> Column:
    """Bytes of a decimal number, with point or comma, and a unit; null where it is no size."""
    raw = F.trim(text)
    number = F.translate(F.regexp_extract(raw, r"^([0-9.,]+)", 1), ",", ".")
    unit = F.lower(F.trim(F.regexp_extract(raw, r"^[0-9.,]*(.*)$", 1)))
    scale = F.create_map(*[x for k, v in SIZE_UNITS.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.floor(number.try_cast("double") * F.try_element_at(scale, unit) + 0.5).cast("long")


def parse_timecode(text: Column) -> Column:
    """Seconds of a plain number, up to three parts between colons, or numbers with units;
    null where it is no time."""
    raw = F.trim(F.translate(text, ",", "."))
    parts = F.split(raw, ":")
    clock = F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + F.when(p.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), p.try_cast("double")))
    scale = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    units = F.create_map(*[x for k, v in scale.items() for x in (F.lit(k), F.lit(v))])
    terms = F.regexp_extract_all(raw, F.lit(r"([0-9]*\.?[0-9]*)(ms|us|µs|ns|h|m|s)"), 0)
    spelled = F.aggregate(terms, F.lit(0.0), lambda total, t: total + F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double") * F.element_at(units, F.regexp_extract(t, r"([a-zµ]+)$", 1)))
    return (
        F.when(raw.contains(":"), F.when(F.size(parts) <= 3, clock))
        .when(raw.rlike(r"^\+?[0-9]*\.?[0-9]+$|^\+?[0-9]+\.$"), raw.try_cast("double"))
        .when(raw.rlike(r"^\+?(([0-9]+\.?[0-9]*|\.[0-9]+)(ms|us|µs|ns|h|m|s))+$"), spelled)
    )


def parse_bool(text: Column) -> Column:
    raw = F.lower(F.trim(text))
    return F.when(raw.isin(*YES), True).when(raw.isin(*NO), False)


def is_number(text: Column) -> Column:
    """Decimal and hexadecimal numbers as a whole, without spaces or suffixes; digits may
    be parted by single underscores. What is too large for a double is none."""
    d = "[0-9](_?[0-9])*"
    h = "[0-9a-f](_?[0-9a-f])*"
    decimal = text.rlike(rf"(?i)^[+-]?({d}(\.({d})?)?|\.{d})(e[+-]?{d})?$")
    size = F.abs(F.translate(text, "_", "").try_cast("double"))
    hexadecimal = text.rlike(rf"(?i)^[+-]?0x_?({h}(\.({h})?)?|\.{h})p[+-]?{d}$")
    return F.when(decimal, size < float("inf")).otherwise(hexadecimal | text.rlike("(?i)^([+-]?inf(inity)?|nan)$"))


def text_bytes(text: Column) -> Column:
    """ASCII as it is, else UTF-16 with a byte order mark."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.encode(text, "US-ASCII")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
