"""Text functions as columns: normal forms, letters of scripts, gates, links, marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = "⺀-鿿豈-﫿"
IDEOGRAPHS = "一-鿿㐀-䶿"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _folded(texts: pd.Series) -> pd.Series:
    if texts.isna().all():  # a batch of plain ASCII
        return texts
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


_compatible = F.pandas_udf(_folded, StringType())


def normal_slug(text: Column) -> Column:
    """compatible composed form, case folded, without separators; plain ASCII takes no Python."""
    folded = F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_compatible(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")


def single_spaced(text: Column) -> Column:
    """no white space between CJK letters, single spaces elsewhere, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?<=[{CJK}])\\s+(?=[{CJK}])", ""), r"\s+", " "))


def letters_only(text: Column) -> Column:
    """CJK letters, a-z and digits of the text in lower case."""
    return F.regexp_replace(F.lower(text), f"[^{IDEOGRAPHS}a-z0-9]+", "")


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{IDEOGRAPHS}]"))


def mostly_cjk(text: Column, share: float = 0.10) -> Column:
    """at least ``share`` of the characters are CJK letters; false for an empty text."""
    return F.coalesce(cjk_count(text) / F.nullif(F.length(text), F.lit(0)) >= share, F.lit(False))


def index_slug(title: Column, most: int = 48) -> Column:
    """the runs of a-z, 0-9 and CJK letters joined by dashes, as far as ``most`` characters."""
    return F.regexp_replace(F.substring(F.array_join(F.regexp_extract_all(F.lower(title), F.lit(f"[a-z0-9{IDEOGRAPHS}]+"), F.lit(0)), "-"), 1, most), "-+$", "")


def node_id(subsystem: Column, kind: Column, title: Column) -> Column:
    """subsystem, a short form of the kind, and the title's slug."""
    return F.concat_ws("-", F.lower(subsystem), F.lower(F.substring(kind, 1, 3)), index_slug(title))


def summary_fits(summary: Column, source: Column, most: int = 300) -> Column:
    """not empty, not too long, in the source's script, and every number and trouble code in it is in the source."""
    literals = F.regexp_extract_all(summary, F.lit(r"[PCBU][0-9A-F]{4}|[0-9]+(?:[.][0-9]+)?"), F.lit(0))
    held = F.forall(literals, lambda x: F.contains(source, x))
    return (F.trim(summary) != "") & (F.length(summary) <= most) & (mostly_cjk(summary, 0.15) == mostly_cjk(source, 0.15)) & held


def image_references(text: Column) -> Column:
    """array of (alt, path) of ``![alt](path)`` whose path stays inside its folder."""
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, p: F.struct(a.alias("alt"), p.alias("path")))
    return F.filter(pairs, lambda r: ~r["path"].rlike(r"^/|(^|/)\.\.(/|$)|^[a-zA-Z][a-zA-Z0-9+.-]*:"))


def images_below(text: Column, stem: str) -> Column:
    """relative paths of images go below ``images/{stem}/``; addresses, absolute paths and ``images/`` stay."""
    return F.regexp_replace(text, r"(!\[[^\]]*\]\()(?!https?:|/|images/)([^)]+\))", f"$1images/{stem}/$2")


def pollution(text: Column) -> Column:
    """F32: how many empty elements and character references a text holds."""
    empty = F.regexp_count(text, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>\s*</\1\s*>"))
    return F.struct(empty.alias("empty_elements"), F.regexp_count(text, F.lit("&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);")).alias("references"))


def canonical_hash(*fields: str) -> Column:
    """the digest of a row as JSON with its fields in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def json_object(text: Column) -> Column:
    """the first object in a text: what is within a fence, if there is one, from the first brace to the last; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def vin(raw: Column) -> Column:
    """the vehicle number of a plain or ``bytearray(b'...')`` cell, null for marks of missing values."""
    inner = F.coalesce(F.nullif(F.regexp_extract(raw, r"bytearray\(b'([^']*)'\)", 1), F.lit("")), F.trim(raw))
    return F.when(~inner.isin("", "N/A", "None"), inner)


def frontmatter(fields: dict[str, Column]) -> Column:
    """a block of quoted ``key: value`` lines between rules; null fields are left out."""
    quoted = [F.when(v.isNotNull(), F.concat(F.lit(f'{k}: "'), F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*quoted), lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"))


def frontmatter_fields(text: Column) -> Column:
    """The flat ``key: value`` lines between rules at a text's start, as a map; empty without any."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(\r?\n|\Z)", 1)
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1), F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)), '^"(.*)"$', "$1"))
    # the last of repeated keys counts
    return F.aggregate(F.transform(lines, entry), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["col1"]), F.create_map(e["col1"], e["col2"])))


def table_rows(html: Column) -> Column:
    """the cells of each row of HTML tables, tags off."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(cells(r), plain))


def redacted(text: Column, label: Column, name: Column) -> Column:
    """a header's vehicle label, then every 17-character vehicle number equal to ``label``, replaced by ``name``."""
    return F.when(label.isNotNull(), F.replace(text, label, name)).otherwise(text)


def directive_kind(text: Column) -> Column:
    """whether a pitfall is about leaving something out or about saying it, by its first words."""
    return F.when(F.lower(text).rlike(r"^\s*(omits?|omitting|fails? to|failing to|forgets?|missing|does not (mention|include|cite)|without mentioning)\b"), "omission").otherwise("assertion")
