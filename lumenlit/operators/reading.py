"""Reading papers and lists as they were landed: TeX in titles, citations in
sentences, records of archives, names in front matter."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions.text import fold, norm

# --- TeX ------------------------------------------------------------------------------------------------------------

# How scripts, symbols and commands are shown.
RAISED = dict(zip("0123456789+-=()/naibcdefghjklmoprstuvwxyz", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾⁄ⁿᵃⁱᵇᶜᵈᵉᶠᵍʰʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻ"))
LOWERED = dict(zip("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ"))
SYMBOLS = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega times cdot leq geq neq approx sim pm infty rightarrow to ell".split(), "αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ×·≤≥≠≈~±∞→→ℓ"))
WRAPPERS = set("texttt textit textbf textsc textrm emph text mathrm mathbf mathit mathcal mathbb mathsf mathtt operatorname boldsymbol bm".split())
DROPPED = set("cite citet citep ref label footnote".split())
ENDINGS = tuple("ing tion sion ment ness ity ally ized ised ance ence able ible ers ies ted ual ary ive ous ful less ward wise ation ical ization isation ational ingly ability".split())
ACCENTS = {"ˆ": "̂", "˜": "̃", "¯": "̄", "˙": "̇"}


def rejoin(text: str) -> str:
    """Words that a line break cut: with an ending behind the hyphen they are
    one word, else a compound."""
    return re.sub(r"(\w)-\s+([a-z]\w*)", lambda m: m[1] + ("" if m[2].startswith(ENDINGS) and len(m[2]) <= 8 else "-") + m[2], text)


class _Tex:
    """Reads TeX once from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def more(self, mark: str = "") -> bool:
        return self.at < len(self.text) and (not mark or self.text[self.at] == mark)

    def group(self) -> str:
        """The group or the one character that comes next, as text."""
        if not self.more("{"):
            c = self.text[self.at : self.at + 1]
            self.at += 1
            return self.command() if c == "\\" else c
        self.at += 1
        inside = self.run("}")
        self.at += 1
        return inside

    def command(self) -> str:
        """What a command shows; its backslash has been read."""
        m = re.compile("[A-Za-z]+").match(self.text, self.at)
        if m is None:
            c = self.text[self.at : self.at + 1]
            self.at += 1
            return c if c in "%&#_$" else ""
        self.at = m.end()
        if m[0] in DROPPED or m[0] in WRAPPERS:
            spaces = re.compile(r"\s*").match(self.text, self.at).end()
            if self.text[spaces : spaces + 1] == "{":
                self.at = spaces
                inside = self.group()
                return inside if m[0] in WRAPPERS else ""
        return SYMBOLS.get(m[0], "")

    def script(self, c: str) -> str:
        body = self.group()
        shown = "".join((RAISED if c == "^" else LOWERED).get(x, x) for x in body)
        return shown if shown != body or not body else f"{c}({body})"

    def run(self, end: str = "") -> str:
        out = []
        while self.at < len(self.text) and self.text[self.at] != end:
            c = self.text[self.at]
            emphasis = c == "_" and not (out and re.search(r"\w$", out[-1])) and re.compile(r"_([A-Za-z][^_]*?)_(?!\w)").match(self.text, self.at)
            self.at += 1
            if emphasis:  # not TeX but the mark-up of feeds
                out.append(emphasis[1])
                self.at = emphasis.end()
            elif c == "\\":
                out.append(self.command())
            elif c in "^_" and self.more() and (self.more("{") or re.match(r"\w|\\", self.text[self.at])):
                out.append(self.script(c))
            elif c not in "${}":
                out.append(c)
        return "".join(out)


def detex(text: str) -> str:
    """Author TeX as readable text, for display."""
    shown = _Tex(rejoin(text)).run()
    shown = re.sub(r"\s+", " ", shown).strip().replace("``", "“").replace("''", "”")
    return re.sub(f"([{''.join(ACCENTS)}])([A-Za-z])", lambda m: m[2] + ACCENTS[m[1]], shown)


def detexed(text: Column) -> Column:
    def run(many: pd.Series) -> pd.Series:
        return many.map(detex, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def is_subsequence(short: str, long: str) -> bool:
    """The words of the short text stand in the long one, in order."""
    words = iter(long.split())
    return all(any(w == x for x in words) for w in short.split())


def elided(text: str, most: int, drop: tuple[str, ...] = ("however", "therefore", "furthermore", "moreover", "notably")) -> str:
    """A shorter reading by deletion only: brackets, then linking words, then
    the tail at a word. What is left is a subsequence of the text's words."""
    out = " ".join(text.split())
    steps = [lambda s: re.sub(r"\s*\([^()]*\)", "", s), lambda s: " ".join(w for w in s.split() if w.strip(",").lower() not in drop)]
    for step in steps:
        shorter = " ".join(step(out).split())
        if len(out) > most and is_subsequence(shorter, text):
            out = shorter
    if len(out) > most:
        out = out[: most + 1].rsplit(" ", 1)[0] if " " in out[: most + 1] else out[:most]
    return out


def squeezed(text: Column) -> Column:
    """Text under which a quote and its source meet: cut words joined, white
    space single, marks and case gone."""
    joined = F.regexp_replace(text, r"(\w)-\s+([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(joined), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def quote_stands(quote: Column, source: Column, least: int = 25) -> Column:
    return (F.length(quote) >= least) & F.contains(squeezed(source), squeezed(quote))


def window_around(sentence: Column, at: Column, length: Column, most: int = 420) -> Column:
    """The sentence, or ``most`` characters of it with the match in the middle;
    what is cut off shows as an ellipsis. ``at`` counts from 1."""
    begin = F.greatest(F.lit(1), F.least(at + F.floor(length / 2) - most // 2, F.length(sentence) - most + 1)).cast("int")
    cut = F.substring(sentence, begin, F.lit(most))
    return F.when(F.length(sentence) <= most, sentence).otherwise(F.concat(F.when(begin > 1, "…").otherwise(""), F.trim(cut), F.when(begin + most - 1 < F.length(sentence), "…").otherwise("")))


# --- citations ------------------------------------------------------------------------------------------------------


def markers(references: DataFrame) -> DataFrame:
    """References (paper, cited, text) with ``pattern``: how a sentence cites
    them, by the name in front and the first year. Those without are dropped."""
    name = F.regexp_extract("text", r"^\s*([^\W\d_][\w'’.-]*(?:,? (?:and|&) [^\W\d_][\w'’-]*| et al\.?)?)", 1)
    year = F.regexp_extract("text", r"\b((?:19|20)\d\d[a-z]?)\b", 1)
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"([.’'-])", r"\\$1"), r",? (?:and|&) ", " (?:and|&) "), " ", r"[\\s\\u00a0]+")
    pattern = F.concat(spaced, F.lit(r"[\s ]*(?:\([\s ]*|,[\s ]*)"), year, F.lit("(?![0-9a-z])"))
    return references.withColumn("pattern", F.when((F.length(name) >= 3) & (year != ""), pattern)).filter("pattern is not null")


def cite_contexts(references: DataFrame, sentences: DataFrame, citers: int = 12, each: int = 2) -> DataFrame:
    """Sentences (paper, pos, text) in which a reference of their own paper is
    cited: cited, paper, pos, text. Of a pair the first ``each``; of a cited
    paper the first ``citers`` by id: what a page shows."""
    m = markers(references).select("paper", "cited", "pattern").distinct()
    hits = sentences.join(m, "paper").filter(F.expr("text rlike pattern")).select("cited", "paper", "pos", "text").distinct()
    own = Window.partitionBy("cited", "paper")
    once = hits.withColumn("n", F.row_number().over(own.orderBy("pos"))).filter(F.col("n") <= each)
    rank = F.dense_rank().over(Window.partitionBy("cited").orderBy("paper"))
    return once.withColumn("k", rank).filter(F.col("k") <= citers).drop("n", "k")


def governor_cites(wanted: DataFrame, references: DataFrame) -> DataFrame:
    """What a sentence names (paper, name, year) to the first reference (paper,
    pos, text) that holds the surname and the year: paper, name, year, pos."""
    surname = F.element_at(F.split(norm(F.regexp_replace(F.split("name", "&")[0], "et al", "")), " "), 1)
    w = wanted.withColumn("surname", surname).filter("surname != ''")
    r = references.select("paper", "pos", norm(F.col("text")).alias("t"), F.col("text").alias("whole"))
    hits = w.join(r, "paper").filter(F.contains("t", "surname") & F.contains("whole", "year"))
    return hits.groupBy("paper", "name", "year").agg(F.min("pos").alias("pos"))


# --- names and terms ------------------------------------------------------------------------------------------------


def names_in(text: Column, name: Column) -> Column:
    """The name stands in the text: under the fold of both, but a name of up to
    four letters only as a word in its own case."""
    key = fold(name)
    bounded = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), name, F.lit(r"\E(?![A-Za-z0-9])"))
    return F.when(key == "", F.lit(False)).when(F.length(key) <= 4, F.rlike(text, bounded)).otherwise(F.contains(fold(text), key))


# Words that say nothing about a corpus.
REGISTER = "the and for with without via from into onto our their its this that these those are was were been being can could should would may might will not but all any both each few more most other some such only own same too very just now new novel propose proposed proposes present presents paper study studies show shows shown demonstrate approach approaches method methods model models framework based results result achieve achieves improve improved improvement performance state art towards toward while however thus therefore furthermore moreover recent recently work works learning learn learned learns training train trained data set sets large small high low first second using use used uses used which when where what how also than then them they have has had between within across over under during through".split()


def corpus_tokens(text: Column) -> Column:
    """Words of three characters or more, without those of the register."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9\-]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(REGISTER))


def term_vocabulary(terms: DataFrame, least: int = 8) -> DataFrame:
    """Of terms (kind, term, proposed): uses, the share in which papers propose
    it, and whether a graph shows it."""
    return terms.groupBy("kind", "term").agg(F.count("*").alias("uses"), F.round(F.avg(F.col("proposed").cast("int")), 3).alias("proposed_share"), (F.count("*") >= least).alias("graph_worthy"))


# --- landed lists ---------------------------------------------------------------------------------------------------

_OAI, _DC = "{http://www.openarchives.org/OAI/2.0/}", "{http://purl.org/dc/elements/1.1/}"
_RECORDS = pa.schema([("page", pa.string()), ("id", pa.string()), ("title", pa.string()), ("date", pa.string()), ("datestamp", pa.string()), ("token", pa.string())])


def oai_records(pages: DataFrame) -> DataFrame:
    """Records of harvested pages (page, xml): id, title, date, datestamp, and
    the page's resumption token. Deleted records and those without a title are
    left out; a page that isn't well-formed fails."""

    def run(stream):
        for batch in stream:
            rows = []
            for page, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = ET.fromstring(xml) if xml else ET.Element("none")
                token = (root.findtext(f".//{_OAI}resumptionToken") or "").strip() or None
                for r in root.iter(f"{_OAI}record"):
                    head = r.find(f"{_OAI}header")
                    if head is None or head.get("status") == "deleted":
                        continue
                    name = (head.findtext(f"{_OAI}identifier") or "").rpartition(":")[2]
                    title = " ".join((r.findtext(f".//{_DC}title") or "").split())
                    if name and title:
                        rows.append((page, name, title, r.findtext(f".//{_DC}date"), head.findtext(f"{_OAI}datestamp"), token))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_RECORDS)], schema=_RECORDS)

    return pages.select("page", "xml").mapInArrow(run, "page string, id string, title string, date string, datestamp string, token string")


def issue_articles(pages: DataFrame) -> DataFrame:
    """Articles of landed issue pages (issue, html): issue, section, id, title,
    authors; only sections of technical and special tracks."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    parts = pages.select("issue", F.explode(F.slice(F.split("html", '<div class="section">'), 2, 100_000)).alias("part"))
    named = parts.select("issue", plain(F.regexp_extract("part", r"(?s)<h2>\s*(.*?)\s*</h2>", 1)).alias("section"), "part").filter(F.col("section").rlike("^AAAI (Technical|Special) Track"))
    items = named.select("issue", "section", F.explode(F.slice(F.split("part", '<div class="obj_article_summary">'), 2, 100_000)).alias("item"))
    link = r'(?s)article/view/(\d+)"[^>]*>(.*?)</a>'
    authors = F.transform(F.split(plain(F.regexp_extract("item", r'(?s)<div class="authors">(.*?)</div>', 1)), ","), lambda x: F.trim(x))
    return items.select("issue", "section", F.regexp_extract("item", link, 1).alias("id"), plain(F.regexp_extract("item", link, 2)).alias("title"), F.filter(authors, lambda x: x != "").alias("authors")).filter("id != ''")
