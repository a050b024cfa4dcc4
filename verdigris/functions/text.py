"""Text rules as Columns: normal forms, field classes, fractions, strata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
TRIM = r"(?U)^\s+|\s+$"


def normalize_text(c: Column) -> Column:
    """Trim and collapse white space; an empty text is null, one of white space alone is empty."""
    return F.regexp_replace(unconstrained_value(c), WS, " ")


def unconstrained_value(c: Column) -> Column:
    """The reading as it is, trimmed; an empty text is null."""
    return F.regexp_replace(F.nullif(c, F.lit("")), TRIM, "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


#: What a field's canonical value is cut out by.
NUMBERED = {
    "survey_number": r"(?iU)(?:khasra|survey|plot|gata)\s*(?:no\.?|num|#)?\s*([0-9a-zA-Z/\-]+)",
    "khata_number": r"(?iU)(?:khatauni|khata|account)\s*(?:no\.?|num|#)?\s*([0-9a-zA-Z/\-]+)",
    "mutation_reference": r"(?iU)(?:mutation|intakal|order)\s*(?:no\.?|ref|#)?\s*([0-9a-zA-Z/\-]+)",
    "share_fraction": r"([0-9]+/[0-9]+)",
}
AREA = r"(?iU)([0-9.]+\s*(?:hectare|ha|acre|bigha|biswa|sq\.?\s*m|square meters?))"
DAY_FIRST, YEAR_FIRST = r"(?U)(\d{2})[/.-](\d{2})[/.-](\d{4})", r"(?U)(\d{4})[/.-](\d{2})[/.-](\d{2})"


def canonical_value(field: Column, c: Column) -> Column:
    """Numbers, shares, areas and dates in one form; the collapsed text where nothing fits.

    Each field costs the search for its own pattern, and the collapsed text only where that fails.
    """
    out = F.when(field == "area", F.lower(found(c, AREA)))
    for name, pattern in NUMBERED.items():
        out = out.when(field == name, found(c, pattern))
    iso = lambda pattern, order: F.when(c.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(c, pattern, k) for k in order]))
    out = out.when(field == "date", F.coalesce(iso(DAY_FIRST, (3, 2, 1)), iso(YEAR_FIRST, (1, 2, 3))))
    return F.coalesce(out, normalize_text(c))


#: The classes in their order with the words that name them; the first that is found counts.
KEYWORDS = {
    "mutation_reference": ["mutation", "intakal", r"dakhil\s*kharij", r"order\s*ref"],
    "date": ["date", "dated", r"scanning\s*date"],
    "relationship": ["s/o", "w/o", "d/o", "c/o", r"son\s+of", r"wife\s+of", r"daughter\s+of", r"care\s+of", "late"],
    "survey_number": ["khasra", "survey", "plot", "gata"],
    "khata_number": ["khatauni", "khata", "account", "khewat"],
    "area": ["area", "hectare", "ha", "acre", "bigha", "biswa", r"sq\s*m", r"square\s*meter"],
    "land_classification": ["classification", r"land\s*type", "chahi", "barani", "irrigated", "unirrigated", "abadi", "agricultural"],
    "share_fraction": ["share", "hissa", "fraction"],
    "owner_name": ["owner", "khatedar", "pattadar", "landowner", "nam", "name", "shri", "smt"],
}
DATE = r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b"
#: What a bare n/n and a bare n are in each type of document.
BARE_PAIR = {"ror": "survey_number", "khasra_khatauni": "survey_number", "jamabandi": "share_fraction"}
BARE_NUMBER = {"jamabandi": "khata_number"}


def classify_field(c: Column, doc_type: Column) -> Column:
    """The field's class by ordered keywords, then by the document's type for bare numbers."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), TRIM, ""))
    return F.element_at(F.transform(F.array(t), lambda t: _class_of(t, doc_type)), 1)  # trimmed once, not for each rule


def _class_of(t: Column, doc_type: Column) -> Column:
    out = None
    for name, words in KEYWORDS.items():
        pattern = rf"(?U)\b(?:{'|'.join(words)})\b" + (f"|{DATE}" if name == "date" else "")
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    by_type = lambda names: F.coalesce(*[F.when(doc_type == k, v) for k, v in names.items()], F.lit("text_line"))
    return out.when(t.rlike(r"(?U)^\d+/\d+$"), by_type(BARE_PAIR)).when(t.rlike(r"(?U)^\d+$"), by_type(BARE_NUMBER)).otherwise("text_line")


def parse_fraction(c: Column) -> Column:
    """struct<n, d> of the first n/d as longs, both null where d is 0 or a number is no long."""
    pair = F.regexp_extract(c, r"([0-9]+)/([0-9]+)", 0)
    whole = lambda k: F.nullif(F.split_part(pair, F.lit("/"), F.lit(k)), F.lit("")).try_cast("bigint")
    ok = (whole(1) >= 0) & (whole(2) > 0)
    return F.struct(F.when(ok, whole(1)).alias("n"), F.when(ok, whole(2)).alias("d"))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def page_digest(uri: Column) -> Column:
    """Last part of the storage key."""
    return F.nullif(F.substring_index(uri, "/", -1), F.lit(""))


def stratum_key(*parts: Column) -> Column:
    """Parts joined by a bar, null as empty."""
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def canonical_stratum(field: Column, script: Column, hand: Column, band: Column) -> Column:
    """The novelty model's key: blanks are filled."""
    fill = lambda c, x: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(x))
    return F.concat_ws("|", fill(field, "default"), fill(script, "default"), fill(hand, "printed"), fill(band, "medium"))


def engine_kind(engine: Column) -> Column:
    e = F.lower(F.coalesce(engine, F.lit("")))
    return F.when(e.contains("hwr"), "handwritten").when(e.contains("ocr") | e.contains("table"), "printed").otherwise("")
