"""Text functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are spelled out, articles and kind words that a name may carry.
SPELLED = (("τ", "tau"), ("∞", "infinity"), ("²", "2"), ("³", "3"))
ARTICLES = ("the", "a")
KIND_WORDS = ("benchmark", "dataset", "corpus", "suite", "benchmarks", "datasets", "suites")
# Words too common to tell titles apart.
TITLE_STOP = ("the", "and", "for", "with", "via", "from", "into", "using", "based", "その")
# Scripts whose words are no terms of English texts.
OTHER_SCRIPTS = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]"


def fold(name: Column) -> Column:
    """Key under which spellings of one name meet: lower case, spelled-out
    letters, no leading article, no trailing kind word, letters digits and +."""
    x = F.lower(name)
    for letter, spelled in SPELLED:
        x = F.replace(x, F.lit(letter), F.lit(spelled))
    x = F.regexp_replace(F.trim(x), rf"^(?:{'|'.join(ARTICLES)})\s+", "")
    x = F.regexp_replace(x, rf"[\s\-_]+(?:{'|'.join(KIND_WORDS)})$", "")
    return F.regexp_replace(x, "[^a-z0-9+]", "")


def norm(text: Column) -> Column:
    """Lower-case words of letters and digits with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def padded(text: Column) -> Column:
    """Normalised text between spaces: contains() then respects word ends."""
    return F.concat(F.lit(" "), norm(text), F.lit(" "))


def title_tokens(text: Column) -> Column:
    """Distinct title words of three letters or more, without stop words."""
    words = F.split(norm(text), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP)))


def basic(label: Column) -> Column:
    """Label without trailing marks, its separators as single spaces."""
    x = F.regexp_replace(F.trim(label), r"[.,;:]+$", "")
    return F.regexp_replace(F.lower(x), r"[\s\-_/]+", " ")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def sentences(text: Column) -> Column:
    """Split after ., ! or ? before a capital or an opening bracket."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z(\[])")


def words(text: Column) -> Column:
    return F.filter(F.split(norm(text), " "), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), r"^www\.", "")


def url_kind(url: Column) -> Column:
    """What a link leads to, by its host and path."""
    host, path = url_host(url), F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1)
    return (
        F.when(host == "github.com", "code")
        .when((host == "huggingface.co") & path.startswith("/datasets/"), "dataset")
        .when((host == "huggingface.co") & path.startswith("/spaces/"), "demo")
        .when(host == "huggingface.co", "model")
        .when(host == "gitlab.com", "code")
        .when(host.isin("zenodo.org", "osf.io"), "archive")
        .otherwise("page")
    )


def stable_id(text: Column) -> Column:
    """A 32-bit id from the text's SHA-1."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")


def bibtex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_])", r"\\$1")
