"""Identity keys of rows (scalar key expressions and content fingerprints)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from braidset import schema

# Separators used when a key is emitted as text.
KEY_SEPARATOR = "\u001f"
NULL_TOKEN = "\u001e"


def key_of(*parts: Column | str) -> Column:
    """Composite text key in which a null part differs from '' and from 'null'."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NULL_TOKEN)) for p in parts]
    return F.concat_ws(KEY_SEPARATOR, *texts)


def local_key(table: str, prefix: str = "") -> Column:
    """Text form of a row's primary key inside its source."""
    return key_of(*[prefix + c for c in schema.primary_key(table)])


def _when_all_set(required: list[str], key: Column) -> Column:
    condition = F.lit(True)
    for name in required:
        condition = condition & F.col(name).isNotNull()
    return F.when(condition, key)


def _folded(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def location_place_key() -> Column:
    """Book/chapter identity; null unless all of its nullable parts are set."""
    return _when_all_set(
        ["BookNumber", "ChapterNumber", "KeySymbol", "MepsLanguage"],
        key_of(F.lit("T"), "BookNumber", "ChapterNumber", "KeySymbol", "MepsLanguage", "Type"),
    )


def location_media_key() -> Column:
    """Recording identity; null unless symbol, language, document and track are set."""
    return _when_all_set(
        ["KeySymbol", "MepsLanguage", "DocumentId", "Track"],
        key_of(F.lit("M"), "KeySymbol", "IssueTagNumber", "MepsLanguage", "DocumentId", "Track", "Type",
               _folded("Specialty"), _folded("Edition")),
    )


def location_full_key() -> Column:
    """Every column but the id and the display title, null being a value of its own."""
    return key_of(F.lit("F"), "BookNumber", "ChapterNumber", "DocumentId", "Track", "IssueTagNumber", "KeySymbol",
                  "MepsLanguage", "Type", _folded("Specialty"), _folded("Edition"))


def location_keys() -> Column:
    """The live identity keys of a location in the order they are tried: (rank, key)."""
    ranked = F.array(
        F.struct(F.lit(1).alias("rank"), location_place_key().alias("key")),
        F.struct(F.lit(2).alias("rank"), location_media_key().alias("key")),
        F.struct(F.lit(3).alias("rank"), location_full_key().alias("key")),
    )
    return F.filter(ranked, lambda k: k["key"].isNotNull())


def tag_key() -> Column:
    return key_of("Type", "Name")


def input_field_key(location: Column | str = "LocationId") -> Column:
    return key_of(location, "TextTag")


def bookmark_slot_key(publication: Column | str = "PublicationLocationId") -> Column:
    return key_of(publication, "Slot")


def bookmark_target_key(publication: Column | str = "PublicationLocationId", location: Column | str = "LocationId") -> Column:
    return key_of(publication, location, "BlockType", "BlockIdentifier")


def range_key() -> Column:
    return key_of("BlockType", "Identifier", "StartToken", "EndToken")


def assignment_key(tag: Column | str, kind: Column | str, ref: Column | str) -> Column:
    return key_of(tag, kind, ref)


def conflict_id(kind: str, identity: Column | str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(identity) if isinstance(identity, str) else identity)


def multiset(*parts: Column) -> list[Column]:
    """Aggregates whose values are equal for equal multisets of rows, in any order.

    Two independent 64-bit hashes are summed exactly (decimal) next to the row
    count, so the state is three numbers per group however many rows it has, and
    partial aggregation applies before the shuffle.
    """
    present = F.count(F.when(parts[0].isNotNull(), 1))
    lanes = [
        F.coalesce(
            F.sum(F.when(parts[0].isNotNull(), F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)"))),
            F.lit(0).cast("decimal(30,0)"),
        )
        for seed in ("braid-a", "braid-b")
    ]
    return [present, *lanes]


def multiset_key(*parts: Column) -> Column:
    """``multiset`` as one text aggregate."""
    return F.concat_ws("/", *[c.cast("string") for c in multiset(*parts)])
