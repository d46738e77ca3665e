"""Quality of a boundary between two consecutive passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that end in a dot without ending a sentence (Polish, then English).
ABBREVIATIONS = (
    "np m\\.in tzn tj itd itp cdn ul al pl os woj gm pow dr prof mgr inż lic hab ks św godz min sek tys mln mld ok ok\\.o nr str rozdz rys tab zob por "
    "etc vs approx ca est fig ref dept govt corp inc ltd llc mr mrs ms dr prof sr jr rev gen sgt cpl pvt cmdr jan feb mar apr jun jul aug sep oct nov dec "
    "st ave blvd rd hwy vol no pp ed eds trans repr"
).split()
INITIAL = "[a-záćęłńóśźż]"
UPPER = "A-ZĄĆĘŁŃÓŚŹŻ"
SENTENCE_END = r"[.!?][\"')\]»›]?$"
STRUCTURE_START = rf"^(#{{1,6}}\s|[-*•–]\s|\d+[.)]\s|[{UPPER}])"

ABBREVIATION = rf"^(?iu)({'|'.join(ABBREVIATIONS)}|{INITIAL})\.$"


def boundary_ok(current: Column, following: Column) -> Column:
    """Whether a split between the texts is acceptable, by the first rule that applies."""
    end = F.regexp_replace(current, r"\s+$", "")
    begin = F.regexp_replace(following, r"^\s+", "")
    last_word = F.regexp_extract(end, r"(\S+)$", 1)
    structure = F.regexp_like(current, F.lit(r"\n[ \t]*\n")) | F.regexp_like(end, F.lit(r"#{1,6}[^\n]*$"))
    sentence = F.regexp_like(end, F.lit(SENTENCE_END)) & ~F.regexp_like(last_word, F.lit(ABBREVIATION))
    lower = F.regexp_like(begin, F.lit(r"^\p{Ll}"))
    first = F.regexp_extract(following, rf"(?iu)([{UPPER}0-9])", 1)
    new_line = F.regexp_like(current, F.lit(r"\n[ \t]*$")) & F.regexp_like(following, F.lit(r"^[ \t]*\n")) & F.regexp_like(first, F.lit(rf"^[{UPPER}0-9]"))
    return (
        F.when(end == "", True).when(structure, True).when(sentence, ~lower).when(new_line, True).otherwise(F.regexp_like(begin, F.lit(STRUCTURE_START)))
    )


def boundary_label(current: Column, following: Column, same_parent: Column) -> Column:
    """good, fail, or end_file where no passage of the same parent follows."""
    return F.when(~F.coalesce(same_parent, F.lit(False)), "end_file").when(boundary_ok(current, following), "good").otherwise("fail")
