"""Text: token sets, families of markets, quality flags, aliases in JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in titles.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "will", "with"]


def tokens(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower-cased words of letters a-z and digits in order, `&` as `and`, aliases replaced."""
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]+", " ")
    words = F.filter(F.split(plain, " +"), lambda w: w != "")
    if not aliases:
        return words
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w))


def token_set(text: Column, stopwords: Sequence[str] = STOPWORDS, aliases: Mapping[str, str] | None = None) -> Column:
    """Sorted distinct tokens of two characters or more that aren't stopwords."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text, aliases), lambda w: (F.length(w) > 1) & ~w.isin(list(stopwords)))))


def flags(text: Column) -> Column:
    """Quality flags of a `;`- or `,`-separated text, trimmed, blanks left out."""
    parts = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), ",", ";"), ";"), lambda f: F.trim(f))
    return F.filter(parts, lambda f: f != "")


def first_json(payload: Column, paths: Sequence[str]) -> Column:
    """The first of several JSON paths with a value that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths])


def first_json_timestamp(payload: Column, paths: Sequence[str]) -> Column:
    """The first of several JSON paths that parses as a timestamp."""
    return F.coalesce(*[F.get_json_object(payload, p).try_cast("timestamp") for p in paths])


def market_family(key: Column, partition: Column | None = None) -> tuple[Column, Column]:
    """(family, provenance) of a ticker: an explicit partition's, else by the prefix of bundled contracts."""
    trimmed = F.upper(F.trim(key))
    blank = key.isNull() | (trimmed == "")
    family = F.when(blank, "family_unknown").when(trimmed.startswith("KXMVE"), "kalshi_mve").otherwise("kalshi_conventional")
    provenance = F.when(blank, "ambiguous_legacy_evidence").otherwise("legacy_ticker_compat")
    if partition is None:
        return family, provenance
    named = F.lower(F.trim(partition))
    explicit = named.isin("kalshi_mve", "kalshi_conventional")
    return F.when(explicit, named).otherwise(family), F.when(explicit, F.lit("partition_provenance")).otherwise(provenance)


def recurring_family(slug: Column) -> Column:
    """The family of recurring up-or-down markets by the slug's end: duration and an epoch of 9 to 12 digits."""
    found = F.regexp_extract(F.coalesce(F.trim(slug), F.lit("")), r"(?i)(?:^|-)(?:updown|up-or-down)-(5m|15m|4h)-[0-9]{9,12}$", 1)
    return F.when(found == "", "polymarket_conventional").otherwise(F.concat(F.lit("polymarket_updown_"), F.lower(found)))


def sorted_digest(payload: Column, without: Sequence[str] = ()) -> Column:
    """SHA-256 of a JSON text with all keys sorted, some top-level ones left out; of the text itself where it isn't JSON.

    Variant objects keep their keys sorted, so the canonical text needs no Python."""
    whole = F.try_parse_json(payload)
    text = F.to_json(whole)
    if without:
        fields = F.from_json(text, "map<string,string>")
        kept = F.map_filter(fields, lambda k, _: ~k.isin(list(without)))
        text = F.when(payload.rlike(r"^\s*\{"), F.to_json(F.array_sort(F.map_entries(kept)))).otherwise(text)
    return F.sha2(F.coalesce(text, payload), 256)
