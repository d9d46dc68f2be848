"""Scalar text functions as Spark columns (H1-H17 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgraph.functions.whitespace import NOT_WS, WS, collapse_spaces

# File endings by kind.
KINDS = {
    "markdown": ("md",),
    "text": ("txt",),
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg"),
    "html": ("html", "htm"),
    "office": ("doc", "docx", "ppt", "pptx"),
    "code": ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "c", "h", "cpp", "cc", "hpp"),
}
INGESTED = ("markdown", "text", "html", "code", "pdf")
NO_IMPORTS = ("image", "office", "pdf")
# Folders that are not walked, besides hidden ones and saved pages' "..._files".
SKIPPED_FOLDERS = ("node_modules", "target", "dist", ".git")
# Patterns of candidate names, structural tokens and sentence starters.
PHRASE = rf"(\p{{Lu}}\p{{Ll}}{{2,}}(?:{WS}+(?:of|the|for|and|in|de|a|v|na|pro){WS}+)?(?:{WS}+\p{{Lu}}\p{{Ll}}{{2,}}){{1,3}})"
ACRONYM = r"(\p{Lu}[\p{Lu}0-9]{1,15})"
STRUCTURAL = "^(?:[IVXLCDM]+|PROP|MSS|PMID|PMC|ISSN|ISBN|DOI|PDF|HTML|URL|FIG|TAB|EQ|CHAP|SEC|VOL|NO|PP|ED|VS|ET|AL)$"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
STARTERS = (
    "The This That These Those And But For However Therefore While When Where What Which There Here It In On At As If We They Our Their His Her Its"
    " One Two First Second Third Finally Thus Hence Since Because Although"
).split()
TRIMMED = "\"'“”,.:;()"
IMPORT_WORDS = ("from ", "require(", "import ")
RESOLVED_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".rs", ".md", ".py")


def ending_of(path: Column) -> Column:
    """The lower-case ending of the last path part, empty if it has none or only a leading dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]*)$", 1))


def kind_of(ending: Column) -> Column:
    """The kind of a file by its ending; null for unknown ones."""
    chain = None
    for kind, endings in KINDS.items():
        chain = F.when(ending.isin(*endings), kind) if chain is None else chain.when(ending.isin(*endings), kind)
    return chain


def walked(path: Column) -> Column:
    """Whether a walk reaches the file: no skipped folder on its way, no temporary office file."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda d: d.startswith(".") | d.endswith("_files") | d.isin(*SKIPPED_FOLDERS))
    return ~skipped & ~F.element_at(F.split(path, "/"), -1).startswith("~$")


def with_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def folder_of(path: Column) -> Column:
    """What stands before the last ``/``, empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def strip_html(raw: Column) -> Column:
    """Text outside of tags; stray ``>`` dropped, white space collapsed, entities and script bodies left as they are."""
    return collapse_spaces(F.replace(F.regexp_replace(raw, "<[^>]*(?:>|$)", ""), F.lit(">"), F.lit("")))


def tokens_of(text: Column) -> Column:
    """Lower-case ASCII words of three characters and more, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2)


def candidates_of(text: Column) -> Column:
    """Names in a text, with repeats: capitalised phrases and acronyms, white space collapsed, structural ones left out."""
    found = F.concat(F.regexp_extract_all(text, F.lit(PHRASE), 1), F.regexp_extract_all(text, F.lit(ACRONYM), 1))
    tidy = F.transform(found, collapse_spaces)
    return F.filter(tidy, lambda t: F.octet_length(t).between(3, 60) & ~t.rlike(STRUCTURAL) & ~F.split(t, " ")[0].isin(*STARTERS))


def normal_name(raw: Column) -> Column:
    """The folded form of a name, null if it is refused: too short or long, structural, an identifier, few letters."""
    t = F.trim(collapse_spaces(raw), F.lit(TRIMMED))
    letters = F.regexp_replace(t, r"\P{IsAlphabetic}", "")
    acronym = (F.length(letters) >= 3) & ~letters.rlike(r"[^\p{Lu}]") & ~t.contains(" ")
    fine = F.length(t).between(3, 60) & ~t.rlike(STRUCTURAL) & ~t.rlike(UUID) & (F.length(letters) >= 3) & ((F.length(t) >= 4) | acronym)
    return F.when(fine, t)


def slug(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)


def point_id(key: Column) -> Column:
    """The identifier of a stored point: 16 bytes of SHA-256 in the form of a version 4 UUID."""
    h = F.sha2(key, 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def quoted_specs(text: Column) -> Column:
    """What stands in quotes after ``from ``, ``require(`` and ``import ``; the look-ahead lets finds overlap."""
    found = [F.regexp_extract_all(text, F.lit(rf"(?s){word.replace('(', chr(92) + '(')}(?={WS}*(['\"])(.*?)\1)"), 2) for word in IMPORT_WORDS]
    return F.concat(*found)


def module_specs(text: Column) -> Column:
    """``name.rs`` for each ``mod name;``."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"mod {WS}*([A-Za-z0-9_]+){WS}*;"), 1), lambda m: F.concat(m, F.lit(".rs")))


def link_specs(text: Column) -> Column:
    """The first word of every ``](...)``."""
    inside = F.regexp_extract_all(text, F.lit(r"\]\(([^)]*)\)"), 1)
    return F.filter(F.transform(inside, lambda s: F.regexp_extract(s, f"^{WS}*({NOT_WS}+)", 1)), lambda s: s != "")


def preview(text: Column, most: int = 220) -> Column:
    return F.substring(text, 1, most)


def chunk_path(node: Column) -> Column:
    """The file of a chunk node, null where the tail is no number."""
    return F.when(node.rlike(r"^(.*)#(\d+)$"), F.regexp_extract(node, r"^(.*)#(\d+)$", 1))


def chunk_number(node: Column) -> Column:
    return F.when(node.rlike(r"^(.*)#(\d+)$"), F.regexp_extract(node, r"^(.*)#(\d+)$", 2).cast("bigint"))


def weight_label(rel: Column, weight: Column) -> Column:
    """``similarity 0.83`` for conflicts, ``w 3`` for the rest."""
    return F.when(rel == "conflicts_with", F.concat(F.lit("similarity "), F.format_string("%.2f", weight / 100))).otherwise(F.concat(F.lit("w "), weight.cast("string")))


