"""Values of filled forms: labels, clean values and the block that goes before a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contents of check boxes and switches.
SWITCHES = ("check", "checked", "off", "yes", "no", "x", "true", "false")


def one_line(value: Column) -> Column:
    """The lines of a value that are not blank, joined by commas."""
    return F.array_join(F.filter(F.transform(F.split(value, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), ", ")


def inferred_label(value: Column) -> Column:
    """What a value looks like, for fields whose own names say nothing."""
    v = F.trim(value)
    size = F.octet_length(v)
    bare = F.replace(v, F.lit("-"), F.lit(""))
    digits = bare.rlike(r"^[0-9]*$")
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    capital = F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    after = F.trim(F.split_part(v, F.lit(","), F.lit(2)))
    return (
        F.when((size <= 4) & v.rlike("^[0-9]*$"), "ID Number")
        .when((size == 11) & (F.length(v) - F.length(bare) == 2) & digits, "Social Security Number")
        .when(size.isin(5, 10) & v.rlike("^[0-9]") & digits, "ZIP Code")
        .when(v.rlike("^[A-Z]{2}$"), "State")
        .when((F.length(v) - F.length(F.replace(v, F.lit(","), F.lit(""))) == 1) & F.octet_length(after).between(2, 12), "City, State, ZIP")
        .when(v.rlike("^[0-9]") & v.contains(" ") & (size > 5), "Address")
        .when(F.size(words).between(2, 3) & capital & F.forall(words, lambda w: F.octet_length(w) <= 15), "Name")
        .when(F.size(words).between(2, 5) & capital, "Business/Entity Name")
        .otherwise("Form Field")
    )


def worth_keeping(value: Column) -> Column:
    v = F.trim(value)
    return (F.octet_length(v) >= 2) & ~F.lower(v).isin(*SWITCHES) & ~v.rlike("^[0-9]{1,2}$")


def summary_block(fields: Column, text: Column) -> Column:
    """A page with its filled fields (array of struct(label, value)) in a block before it."""
    kept = F.filter(fields, lambda f: worth_keeping(f["value"]))
    bare = lambda f: F.replace(F.replace(f["label"], F.lit("[0]"), F.lit("")), F.lit("[1]"), F.lit(""))
    line = lambda f: F.concat(F.when((bare(f) == "") | bare(f).rlike("^f[12]_"), inferred_label(one_line(f["value"]))).otherwise(bare(f)), F.lit(": "), one_line(f["value"]))
    return F.when(F.size(kept) > 0, F.concat(F.lit("FILLED FORM DATA:\n"), F.array_join(F.transform(kept, line), "\n"), F.lit("\n\n"), text)).otherwise(text)


def not_in_text(fields: Column, text: Column) -> Column:
    return F.filter(fields, lambda f: (F.octet_length(F.trim(f["value"])) > 1) & ~text.contains(F.trim(f["value"])))
