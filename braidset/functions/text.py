"""Text, label and display functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Every character that counts as white space at the ends of a text.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Device names by class, first match wins.
DEVICE_PATTERNS = (
    ("tablet", r"ipad|tablet|\btab\b"),
    ("phone", r"iphone|pixel|galaxy|android|phone|mobile"),
    ("desktop", r"desktop|laptop|macbook|imac|\bmac\b|windows|\bpc\b|book|surface"),
)

# Highlight colours by index.
HIGHLIGHT_COLORS = (
    (0, "No colour", "#9aa3b8"),
    (1, "Yellow", "#fde047"),
    (2, "Green", "#86efac"),
    (3, "Blue", "#93c5fd"),
    (4, "Pink", "#f9a8d4"),
    (5, "Orange", "#fdba74"),
    (6, "Purple", "#d8b4fe"),
)
UNKNOWN_COLOR = "#9aa3b8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_trim(c: Column | str) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.btrim(_col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(full_trim(c), F.lit("")) == ""


def normalize_text(c: Column | str) -> Column:
    """Form in which white-space-only edits vanish; null becomes ''."""
    text = F.coalesce(_col(c), F.lit(""))

    def where_found(current: Column, signs: tuple[str, ...], pattern: str, by: str) -> Column:
        # A plain substring test spares most texts the regular expression.
        found = F.lit(False)
        for sign in signs:
            found = found | F.contains(current, F.lit(sign))
        return F.when(found, F.regexp_replace(current, pattern, by)).otherwise(current)

    # The patterns leave out what would replace a text by itself (a lone space, a lone break).
    text = where_found(text, ("\r",), r"\r\n?", "\n")
    text = where_found(text, ("  ", "\t", "\u00a0"), r"[ \t\x{00A0}]{2,}|[\t\x{00A0}]", " ")
    text = where_found(text, (" \n", "\n "), r" \n ?|\n ", "\n")
    return full_trim(text)


def is_empty_note(title: Column | str = "Title", content: Column | str = "Content") -> Column:
    return (normalize_text(title) == "") & (normalize_text(content) == "")


def target_count() -> Column:
    """How many of the three targets of a tag assignment are set."""
    return sum((F.col(c).isNotNull().cast("int") for c in ("NoteId", "LocationId", "PlaylistItemId")), F.lit(0))


def describe_location(prefix: str = "", missing: Column | None = None) -> Column:
    """One-line description of a location row; never shows user text.

    ``missing`` tells that there is no such row (defaults to a null id).
    """
    def c(name: str) -> Column:
        return F.col(prefix + name)

    title = F.nullif(F.coalesce(full_trim(c("Title")), F.lit("")), F.lit(""))
    symbol = F.nullif(c("KeySymbol"), F.lit(""))
    chapter = F.when(F.coalesce(c("ChapterNumber"), F.lit(0)) != 0, F.concat(F.lit(" ch. "), c("ChapterNumber")))
    book = F.when(
        F.coalesce(c("BookNumber"), F.lit(0)) != 0,
        F.concat(F.lit("book "), c("BookNumber"), F.coalesce(chapter, F.lit(""))),
    )
    parts = F.concat_ws(
        " · ",
        F.coalesce(title, symbol),
        book,
        F.when(F.coalesce(c("DocumentId"), F.lit(0)) != 0, F.concat(F.lit("doc "), c("DocumentId"))),
        F.when(c("Track").isNotNull(), F.concat(F.lit("track "), c("Track"))),
        F.when(F.coalesce(c("IssueTagNumber"), F.lit(0)) != 0, F.concat(F.lit("issue "), c("IssueTagNumber"))),
        F.when(title.isNotNull() & symbol.isNotNull(), F.concat(F.lit("("), symbol, F.lit(")"))),
    )
    gone = c("LocationId").isNull() if missing is None else missing
    return F.when(gone, F.lit("unknown location")).when(
        parts == "", F.concat(F.lit("location #"), c("LocationId"))
    ).otherwise(parts)


def file_extension(c: Column | str) -> Column:
    """Extension with its dot; '' when there is none or the only dot leads the name."""
    return F.regexp_extract(_col(c), r"(?s)^.+(\.[^.]*)$", 1)


def file_base(c: Column | str) -> Column:
    column = _col(c)
    return F.substring(column, F.lit(1), F.length(column) - F.length(file_extension(column)))


def path_key(c: Column | str) -> Column:
    return F.lower(_col(c))


def format_bytes(c: Column | str) -> Column:
    """Size as B, KB, MB or GB: one decimal below 100, none from there on."""
    n = _col(c).cast("double")
    step = F.when(n < 1024.0**2, F.lit(1)).when(n < 1024.0**3, F.lit(2)).otherwise(F.lit(3))
    value = n / F.pow(F.lit(1024.0), step)
    number = F.when(value >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    unit = F.element_at(F.array(F.lit("KB"), F.lit("MB"), F.lit("GB")), step)
    return (
        F.when(n.isNull() | F.isnan(n) | (n < 0) | (n == float("inf")), F.lit("?"))
        .when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .otherwise(F.concat(number, F.lit(" "), unit))
    )


def format_count(c: Column | str) -> Column:
    return F.format_number(_col(c), 0)


def plural(c: Column | str, noun: str, many: str | None = None) -> Column:
    n = _col(c)
    return F.concat(format_count(n), F.lit(" "), F.when(n == 1, F.lit(noun)).otherwise(F.lit(many or noun + "s")))


def device_kind(c: Column | str) -> Column:
    name = F.lower(F.coalesce(_col(c), F.lit("")))
    chain = None
    for kind, pattern in DEVICE_PATTERNS:
        chain = F.when(name.rlike(pattern), kind) if chain is None else chain.when(name.rlike(pattern), kind)
    return chain.otherwise("unknown")


def color_name(c: Column | str) -> Column:
    index = _col(c)
    names = F.create_map(*[F.lit(v) for i, name, _ in HIGHLIGHT_COLORS for v in (i, name)])
    return F.coalesce(F.try_element_at(names, index), F.concat(F.lit("Colour "), index))


def color_hex(c: Column | str) -> Column:
    codes = F.create_map(*[F.lit(v) for i, _, code in HIGHLIGHT_COLORS for v in (i, code)])
    return F.coalesce(F.try_element_at(codes, _col(c)), F.lit(UNKNOWN_COLOR))


def text_change(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Words added, removed and kept between two texts of a row, as multisets.

    Words are counted per key before the two sides meet, so the joined rows are
    one per distinct word, not one per occurrence.
    """
    def words(text: str, name: str) -> DataFrame:
        exploded = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")).alias("_word"))
        return exploded.where("_word <> ''").groupBy(*keys, "_word").agg(F.count("*").alias(name))

    both = words(before, "_b").join(words(after, "_a"), [*keys, "_word"], "full_outer")
    b, a = F.coalesce("_b", F.lit(0)), F.coalesce("_a", F.lit(0))
    totals = both.groupBy(*keys).agg(
        F.sum(F.greatest(a - b, F.lit(0))).alias("words_added"),
        F.sum(F.greatest(b - a, F.lit(0))).alias("words_removed"),
        F.sum(F.least(a, b)).alias("words_kept"),
    )
    filled = df.select(*keys).join(totals, keys, "left").fillna(0, ["words_added", "words_removed", "words_kept"])
    total = F.col("words_added") + F.col("words_removed") + F.col("words_kept")
    changed = F.col("words_added") + F.col("words_removed")
    return filled.withColumn("changed_share", F.when(total == 0, F.lit(0.0)).otherwise(F.round(changed / total, 6)))
