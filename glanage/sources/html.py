"""HTML bulletins: one Python pass takes the pieces out of a page, built-in functions make fields of them.

``pieces`` is an Arrow UDF around the standard library's parser; all rules
about which piece becomes which field are Column expressions, so they stay
visible to the optimizer and can be tested one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements without end tag, as fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PIECES = (
    "struct<title: string, has_author: boolean, error: string,"
    " spans: array<struct<cls: string, td: int, text: string, strings: array<string>>>,"
    " centred: array<struct<n: int, src: string, legend: string>>,"
    " cells: array<struct<td: int, text: string>>>"
)
NBSP = " "


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.has_author = False
        self.spans: list[dict] = []
        self.centred: list[dict] = []
        self.cells: list[dict] = []
        self.open: list[tuple[str, object]] = []  # (tag, what it collects)
        self.divs = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        what: object = None
        if tag == "meta" and a.get("name", "").lower() == "author":
            self.has_author = True
        elif tag == "td":
            what = {"td": len(self.cells), "text": ""}
            self.cells.append(what)
        elif tag == "span":
            what = {"cls": a.get("class", ""), "td": self._td(), "text": "", "strings": []}
            self.spans.append(what)
        elif tag == "div" and "text-align: center" in a.get("style", ""):
            self.divs += 1
            what = {"n": self.divs, "src": None, "legend": None}
            self.centred.append(what)
        elif tag == "img":
            for kind, div in reversed(self.open):
                if kind == "div" and div is not None:
                    div["src"] = div["src"] or a.get("src")
                    break
        if tag not in VOID:
            self.open.append((tag, what))

    def _td(self) -> int:
        return next((w["td"] for t, w in reversed(self.open) if t == "td" and w is not None), -1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for _, what in self.open[i:]:
                    if isinstance(what, dict) and what.get("cls") is not None and "style21" in what["cls"]:
                        div = next((w for t, w in reversed(self.open[:i]) if t == "div" and w is not None), None)
                        if div is not None and div["legend"] is None:
                            div["legend"] = what["text"].strip()
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title = (self.title or "") + data
        if any(t in ("script", "style") for t, _ in self.open):
            return
        for tag, what in self.open:
            if isinstance(what, dict) and "text" in what:
                what["text"] += data
                if tag == "span" and data.strip():
                    what["strings"].append(data.strip())


def parse(page: str | None) -> dict:
    """The pieces of one page; what goes wrong is told in ``error``."""
    p, error = _Parser(), None
    if page is None:
        return {"title": None, "has_author": False, "error": "no page", "spans": [], "centred": [], "cells": []}
    try:
        p.feed(page)
        p.close()
    except Exception as e:  # one bad page must not end the job; it is counted by its error
        error = f"{type(e).__name__}: {e}"
    return {"title": p.title, "has_author": p.has_author, "error": error, "spans": p.spans, "centred": p.centred, "cells": p.cells}


def pieces(page: Column) -> Column:
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            yield pd.DataFrame([parse(x) for x in s], columns=["title", "has_author", "error", "spans", "centred", "cells"])

    return F.pandas_udf(run, PIECES)(page)


def read_pages(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and html of every file of a folder, or of those that match ``glob`` (``*.{htm,html}``)."""
    pages = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


# --- fields ------------------------------------------------------------------------------------------------------


def document_id(path: Column) -> Column:
    """File name without folder and ending, whichever slash the folder has."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def title_parts(title: Column) -> Column:
    """date, numero and titre of ``yyyy/MM/dd > BE France NNN > title``; null where a part is missing or no date."""
    parts = F.split(F.translate(title, NBSP, " "), ">")
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    number = F.regexp_extract(at(1), r"BE France.*?(\d+)\s*$", 1)
    return F.struct(
        F.try_to_date(at(0), "yyyy/M/d").alias("date"),
        F.when(number != "", number).cast("int").alias("numero"),
        F.when(F.size(parts) > 2, F.trim(F.array_join(F.slice(parts, 3, 1000), ">"))).alias("titre"),
    )


def _of_class(p: Column, cls: str) -> Column:
    return F.filter(p["spans"], lambda s: F.array_contains(F.split(s["cls"], r"\s+"), cls))


def _texts(spans: Column) -> Column:
    return F.filter(F.transform(spans, lambda s: F.trim(F.translate(s["text"], NBSP + "\n", "  "))), lambda t: t != "")


def rubriques(p: Column) -> Column:
    """Every section heading without a slash."""
    return F.filter(_texts(_of_class(p, "style42")), lambda t: ~F.contains(t, F.lit("/")))


def rubrique(p: Column) -> Column:
    return F.get(rubriques(p), F.lit(0))


def author(p: Column) -> Column:
    """From the line with ``- name - email``, only on pages that name an author in their head; null-safe."""
    lines = F.filter(_texts(_of_class(p, "style95")), lambda t: F.contains(t, F.lit("email")) & F.contains(t, F.lit("-")))
    bits = F.split(F.get(lines, F.lit(0)), "-")
    return F.when(p["has_author"], F.nullif(F.trim(F.array_join(F.slice(bits, 2, 2), "-")), F.lit("")))


#: What stands behind the name in a contact line, as a fixed value.
BEHIND_NAME = r"(?:: tél\.|\s-\s*email\s*:)"


def author_of_contact(p: Column) -> Column:
    """The name before ``: tél.`` or `` - email :`` in the contact line."""
    lines = F.filter(_texts(p["spans"]), lambda t: t.rlike("(?i)" + BEHIND_NAME))
    name = F.regexp_extract(F.get(lines, F.lit(0)), rf"(?i)^(.*?)\s*{BEHIND_NAME}", 1)
    last = F.trim(F.element_at(F.split(name, " - "), -1))
    return F.when((F.length(last) > 3) & (F.contains(last, F.lit(" ")) | (F.initcap(last) == last)), last)


def body(p: Column) -> Column:
    """The stretches of text that end with a full stop, joined by blanks."""
    strings = F.flatten(F.transform(_of_class(p, "style95"), lambda s: s["strings"]))
    return F.array_join(F.filter(strings, lambda t: F.endswith(t, F.lit("."))), " ")


def body_scoped(p: Column) -> Column:
    """Text of the cell that holds the heading, without credits; all text spans if there is no such cell."""
    td = F.get(F.transform(_of_class(p, "style17"), lambda s: s["td"]), F.lit(0))
    all_ = _of_class(p, "style95")
    own = F.filter(all_, lambda s: s["td"] == td)
    chosen = F.when(F.coalesce(F.size(own) > 0, F.lit(False)), own).otherwise(all_)
    good = F.filter(_texts(chosen), lambda t: ~F.contains(t, F.lit("Rédacteurs")) & ~F.contains(t, F.lit("Pour en savoir plus")))
    return F.array_join(good, " ")


def images(p: Column) -> Column:
    """Images in centred blocks with their legends."""
    shown = F.filter(p["centred"], lambda c: c["src"].isNotNull() & c["legend"].isNotNull())
    return F.transform(shown, lambda c: F.struct(c["src"].alias("urlImage"), c["legend"].alias("legendeImage")))


def images_by_number(p: Column, doc_id: Column, folder: str = "../BULLETINS/IMAGESWEB") -> Column:
    """Images named after the document and the number of their centred block; credits are no legend."""
    shown = F.filter(p["centred"], lambda c: c["src"].isNotNull())
    legend = lambda c: F.when(~F.startswith(F.lower(c["legend"]), F.lit("crédits")), c["legend"])
    return F.transform(shown, lambda c: F.struct(F.concat(F.lit(folder + "/"), doc_id, F.lit("_0"), c["n"].cast("string"), F.lit(".jpg")).alias("urlImage"), legend(c).alias("legendeImage")))


def contacts(p: Column) -> Column:
    return F.filter(_texts(_of_class(p, "style85")), lambda t: F.contains(t, F.lit("-")))


#: Class and word of a label that names the editors, as fixed values.
EDITOR_CLASS, EDITOR = "style28", "Rédacteur"


def contact(p: Column, label: str = "Pour en savoir plus, contacts :") -> Column:
    """Lines of the cell after the one with the label; not those that stand behind a label of editors, wherever in the page that is."""
    td = F.get(F.transform(F.filter(p["cells"], lambda c: F.contains(c["text"], F.lit(label))), lambda c: c["td"]), F.lit(0))
    of = lambda s, cls: F.array_contains(F.split(s["cls"], r"\s+"), cls)
    editors = F.array_position(F.transform(p["spans"], lambda s: F.coalesce(of(s, EDITOR_CLASS) & F.contains(s["text"], F.lit(EDITOR)), F.lit(False))), True)
    own = F.filter(p["spans"], lambda s, i: of(s, "style85") & (s["td"] == td + 1) & ((editors == 0) | (i + 1 < editors)))
    return F.nullif(F.array_join(_texts(own), " "), F.lit(""))


def bulletins(pages: DataFrame) -> DataFrame:
    """One bulletin per page (path, html), ids once; ``error`` says what went wrong with a page."""
    p = F.col("p")
    t = title_parts(p["title"])
    found = pages.select(document_id(F.col("path")).alias("fichier"), pieces(F.col("html")).alias("p"))
    return found.select(
        "fichier",
        t["numero"].alias("numero"),
        t["date"].alias("date"),
        rubrique(p).alias("rubrique"),
        t["titre"].alias("titre"),
        F.coalesce(author(p), author_of_contact(p)).alias("auteur"),
        body_scoped(p).alias("texte"),
        images(p).alias("images"),
        contact(p).alias("contact"),
        p["error"].alias("error"),
    ).dropDuplicates(["fichier"])


def ingest_counts(found: DataFrame) -> DataFrame:
    """found, processed and errors."""
    return found.agg(F.count("*").alias("found"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"))
