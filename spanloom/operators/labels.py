"""Values that a label announces: `label: value` lines, and blocks of labels that are followed by as many values.

Labels are looked up without case, accents and a colon at their end. All is done in a document's row by array expressions, and each line is looked up once.
A null or empty text has no fields; repeated fields are given as often as they are there, in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import fold_accents

#: Labels of forms in English, French, German and Spanish, by what they announce. Another mapping may be passed.
LABELS = {
    "name": ("name", "full name", "first name", "last name", "nom", "prenom", "vorname", "nachname", "nombre", "apellido", "apellidos"),
    "email": ("email", "e-mail", "mail", "courriel", "correo", "correo electronico"),
    "phone": ("phone", "telephone", "tel", "mobile", "telefon", "handy", "telefono", "movil"),
    "location": ("address", "city", "adresse", "ville", "anschrift", "ort", "stadt", "direccion", "ciudad"),
    "date": ("date of birth", "birth date", "dob", "date de naissance", "geburtsdatum", "fecha de nacimiento"),
    "company": ("company", "employer", "societe", "entreprise", "firma", "arbeitgeber", "empresa"),
    "iban": ("iban",),
    "national_id": ("ssn", "national id", "passport", "passeport", "ausweisnummer", "dni", "pasaporte"),
}
#: Least and most labels of a block.
LEAST, MOST = 3, 20
FIELD = "array<struct<label:string,category:string,value:string>>"


def _category(label: Column, labels: Mapping[str, tuple[str, ...]]) -> Column:
    """What a line announces, or null."""
    key = F.regexp_replace(F.trim(F.lower(fold_accents(label))), r"\s*:$", "")
    return F.element_at(F.create_map(*[F.lit(x) for category, names in labels.items() for name in names for x in (name, category)]), key)


def _lines(text: Column, labels: Mapping[str, tuple[str, ...]]) -> Column:
    """array<struct<line, category>>: trimmed lines; the category of those that are a label and nothing else."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.trim(x).alias("line"), _category(x, labels).alias("category")))


def _bare(label: Column) -> Column:
    return F.regexp_replace(label, r"\s*:$", "")


def fields(text: Column, labels: Mapping[str, tuple[str, ...]] = LABELS) -> Column:
    """array<struct<label, category, value>>: `label: value` in a line, or a label with a colon and its value in the next line, if that is no label."""
    head = lambda x: F.trim(F.regexp_extract(x["line"], r"^([^:=]{1,40}?)\s*[:=]\s*(.+)$", 1))

    def found(lines: Column, x: Column, i: Column) -> Column:
        own = F.struct(head(x).alias("label"), _category(head(x), labels).alias("category"), F.trim(F.regexp_extract(x["line"], r"^([^:=]{1,40}?)\s*[:=]\s*(.+)$", 2)).alias("value"))
        after = F.get(lines, i + 1)
        # A line with a label of its own is no value.
        free = after["category"].isNull() & _category(head(after), labels).isNull() & (after["line"] != "")
        below = F.struct(_bare(x["line"]).alias("label"), x["category"].alias("category"), after["line"].alias("value"))
        return F.when(own["category"].isNotNull(), own).when(x["category"].isNotNull() & x["line"].endswith(":") & free, below)

    return let(_lines(text, labels), lambda lines: F.filter(F.transform(lines, lambda x, i: found(lines, x, i)), lambda s: s.isNotNull())).cast(FIELD)


def blocks(text: Column, labels: Mapping[str, tuple[str, ...]] = LABELS) -> Column:
    """array<struct<label, category, value>>: LEAST to MOST lines that are labels only and then as many lines with values, matched in order."""

    def zipped(lines: Column, is_label: Column, x: Column, i: Column) -> Column:
        begins = x["category"].isNotNull() & ~F.coalesce(F.get(is_label, i - 1), F.lit(False))
        many = F.greatest(F.array_position(F.slice(is_label, i + 1, MOST + 1), False) - 1, F.lit(0)).cast("int")
        values = F.slice(lines, i + 1 + many, many)
        whole = (many >= LEAST) & (F.size(values) == many) & F.forall(values, lambda v: v["category"].isNull() & (v["line"] != ""))
        pairs = F.zip_with(F.slice(lines, i + 1, many), values, lambda a, b: F.struct(_bare(a["line"]).alias("label"), a["category"].alias("category"), b["line"].alias("value")))
        return F.when(begins & (many >= LEAST), F.when(whole, pairs))

    def blocked(lines: Column) -> Column:
        flags = F.transform(lines, lambda x: x["category"].isNotNull())
        return let(flags, lambda is_label: F.filter(F.transform(lines, lambda x, i: zipped(lines, is_label, x, i)), lambda s: s.isNotNull()))

    return F.flatten(let(_lines(text, labels), blocked)).cast(FIELD)
