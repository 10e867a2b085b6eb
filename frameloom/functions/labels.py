"""Columns over tags and argument labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish case names in labels and the case values of tags.
CASES = {"mian": "nom", "dop": "gen", "cel": "dat", "bier": "acc", "narz": "inst", "miej": "loc", "wol": "voc", "pop": "pop?", "str": "str"}
#: Parts of speech of predicates; those whose case is the third, and the second part of the tag.
VERB_POS = ("inf", "praet", "fin", "impt", "imps", "bedzie", "pred", "winien")
CASE_THIRD = ("subst", "ger", "num", "psubst", "adj", "padj", "ppron12", "ppron3")
CASE_SECOND = ("siebie", "prep")


def tag_part(ctag: Column, n: int) -> Column:
    """Part ``n`` (from 0) of a colon-separated tag; null where there is none."""
    return F.get(F.split(ctag, ":"), F.lit(n))


def pos(ctag: Column) -> Column:
    return tag_part(ctag, 0)


def is_verb(ctag: Column) -> Column:
    return F.coalesce(pos(ctag).isin(*VERB_POS), F.lit(False))


def feature(text: Column) -> Column:
    """A feature value: without blanks, tabs and line ends; ``_`` where nothing is left."""
    return F.coalesce(F.nullif(F.translate(text, " \t\n", ""), F.lit("")), F.lit("_"))


def case_of(ctag: Column) -> Column:
    """Case by part of speech, else ``_``; also where the tag is too short."""
    p = pos(ctag)
    return F.coalesce(F.when(p.isin(*CASE_THIRD), tag_part(ctag, 2)).when(p.isin(*CASE_SECOND), tag_part(ctag, 1)), F.lit("_"))


def aspect_feature(ctag: Column) -> Column:
    return F.coalesce(F.when(pos(ctag) == "inf", tag_part(ctag, 1)), F.lit("_"))


def aspect_of(ctag: Column) -> Column:
    """Aspect of an occurrence: ``imperf`` where the tag says so, else ``perf``."""
    return F.when(F.contains(ctag, F.lit("imperf")), "imperf").otherwise("perf")


def dictionary_aspect(ctag: Column) -> Column:
    """The same on the dictionary's side, where it can be open (``_``)."""
    return F.when(F.contains(ctag, F.lit("imperf")), "imperf").when(F.contains(ctag, F.lit("perf")), "perf").otherwise("_")


def realizations(label: Column, base: Column) -> Column:
    """The frame realizations that an argument label can fill, as an array; empty for labels of another kind.

    ``subj`` gives ``subj``, which slots with that modifier and an np carry. ``base`` is the head's lemma.
    """
    head = F.regexp_extract(label, r"^([a-z]+)", 1)
    first = F.trim(F.regexp_extract(label, r"^[a-z]+\(([^,)]*)", 1))
    second = F.trim(F.regexp_extract(label, r"^[a-z]+\([^,]*,([^,)]*)\)", 1))
    names = F.create_map(*[F.lit(x) for pair in CASES.items() for x in pair])
    case1, case2 = F.element_at(names, first), F.element_at(names, second)
    wrap = lambda kind, *inside: F.concat(F.lit(kind + "("), *inside, F.lit(")"))
    prep = lambda case: F.concat(head, F.lit("("), first, F.lit(","), case, F.lit(")"))
    wide = F.coalesce(case2.isin("acc", "gen") | ((case2 == "nom") & (first == "jako")), F.lit(False))
    after_po = F.when((first == "po") & (head == "prepadjp"), F.array(F.lit("prepadjp(po,postp)"))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(label == "subj", F.array(F.lit("subj")))
        .when(label.isin("sie", "refl"), F.array(F.lit("refl")))
        .when(label == "nonch", F.array(F.lit("nonch")))
        .when(label == "advp", F.array(F.lit("xp(mod)"), F.lit("advp(misc)"), F.lit("advp(pron)")))
        .when((head == "np") & case1.isin("acc", "gen"), F.array(wrap("np", case1), F.lit("np(str)"), F.lit("np(part)")))
        .when((head == "np") & case1.isNotNull(), F.array(wrap("np", case1)))
        .when((head == "adjp") & case1.isin("acc", "gen"), F.array(wrap("adjp", case1), F.lit("adjp(str)"), F.lit("adjp(part)")))
        .when((head == "adjp") & case1.isNotNull(), F.array(wrap("adjp", case1), F.lit("adjp(pred)")))
        .when(head.isin("prepnp", "prepadjp") & case2.isNotNull() & wide, F.concat(F.array(prep(case2), prep(F.lit("str"))), after_po))
        .when(head.isin("prepnp", "prepadjp") & case2.isNotNull(), F.concat(F.array(prep(case2)), after_po))
        .when((head == "sentp") & (first == "pz"), F.array(F.lit("cp(int)"), wrap("cp", F.coalesce(base, F.lit(""))), wrap("compar", F.coalesce(base, F.lit("")))))
        .when((head == "sentp") & first.isin("że", "żeby", "iż"), F.array(wrap("cp", first), F.lit("cp(żeby2)")))
        .when(head == "sentp", F.array(wrap("cp", first)))
        .when((head == "infp") & (first == "dk"), F.array(F.lit("infp(perf)"), F.lit("infp(_)")))
        .when((head == "infp") & (first == "nd"), F.array(F.lit("infp(imperf)"), F.lit("infp(_)")))
        .when(head == "infp", F.array(F.lit("infp(unknown)"), F.lit("infp(_)")))
        .otherwise(F.array().cast("array<string>"))
    )
