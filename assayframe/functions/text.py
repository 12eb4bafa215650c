"""Text, hashing and document-structure expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = ("triggering", "functional", "performance")
PREVIEW_CHARS = 500
KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)*$"


#: white space and line ends as Python knows them, as classes of regular expressions
SPACE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_END = "(?>\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"
_IN_LINE = "[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"


def strip(text: Column) -> Column:
    """A text without white space of any kind at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def hash_content(text: Column) -> Column:
    """The first 12 hex digits of a text's sha256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def case_cache_key(source: Column, content: Column) -> Column:
    """The source without any ``.yaml``, a hyphen and the content's hash."""
    return F.concat(F.replace(source, F.lit(".yaml"), F.lit("")), F.lit("-"), hash_content(content))


def truncate_response(text: Column, most: int = PREVIEW_CHARS) -> Column:
    return F.coalesce(F.left(text, F.lit(most)), F.lit(""))


def snippet(text: Column, most: int) -> Column:
    """The start of a text, always followed by three dots."""
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(most)), F.lit("..."))


def format_prompt(prompt: Column, is_list: Column | None = None) -> Column:
    """Turns of a list prompt numbered from 1, one a line; a plain prompt as it is."""
    turns = F.array_join(F.transform(prompt, lambda x, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(": "), x)), "\n")
    return turns if is_list is None else F.when(is_list, turns).otherwise(prompt[0])


def name_part(name: Column, position: Column) -> Column:
    """A file-name part: other characters than word ones and hyphens become one hyphen; candidate-N if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w-]", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.btrim(clean, F.lit("-")), F.lit("")), F.concat(F.lit("candidate-"), (position + 1).cast("string")))


def parse_domain(value: Column) -> Column:
    low = F.lower(strip(value))
    return F.when(low.isin(*DOMAINS), low)


def word_count(text: Column) -> Column:
    """Words as Python splits them; each becomes one sign in the place of an array's entry."""
    signs = F.regexp_replace(text, r"(?U)[^\s\x1c-\x1f]+", "w")
    return F.length(F.regexp_replace(signs, "[^w]+", "")).cast("bigint")


def kebab(value: Column) -> Column:
    return value.rlike(KEBAB)


def opens_frontmatter(content: Column) -> Column:
    """Whether the first line is ``---`` when stripped."""
    return content.rlike(rf"\A{_IN_LINE}---{_IN_LINE}(?:{_END}|\z)")


def closes_frontmatter(content: Column) -> Column:
    """Whether a later line is ``---`` when stripped."""
    return content.rlike(rf"{_END}{_IN_LINE}---{_IN_LINE}(?:{_END}|\z)")


def raw_frontmatter(content: Column) -> Column:
    """The lines between the first line and the next that is ``---``, both when stripped; null if there are not two."""
    lines = F.regexp_extract(content, rf"\A{_IN_LINE}---{_IN_LINE}{_END}(?:((?s:.*?)){_END})??{_IN_LINE}---{_IN_LINE}(?:{_END}|\z)", 1)
    return F.when(opens_frontmatter(content) & closes_frontmatter(content), F.regexp_replace(lines, _END, "\n"))


def split_frontmatter(content: Column) -> tuple[Column, Column]:
    """(frontmatter text or null, body): a document that starts with ``---``, up to the first ``---`` at the start of a line."""
    close = F.locate("\n---", content, 4)
    has = F.startswith(content, F.lit("---")) & (close > 0)
    body = content.substr(close + 4, F.length(content))
    body = F.when(F.startswith(body, F.lit("\n")), body.substr(F.lit(2), F.length(body))).otherwise(body)
    return F.when(has, content.substr(F.lit(4), close - 4)), F.when(has, body).otherwise(content)


def simple_fields(front: Column) -> Column:
    """``key: value`` lines of a frontmatter as a map; quotes around values are taken off, the first of equal keys counts.

    Nested and multi-line values need the reader in sources.documents, which parses the whole frontmatter.
    """
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+\s*:(\s|$)"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(strip(x.substr(F.locate(":", x) + 1, F.length(x))), r"""^(["'])(.*)\1$""", "$2").alias("value")),
    )
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def section_items(body: Column, section: str) -> Column:
    """Items of the markdown section of that name (a regular expression): the numbered ones, or else the bulleted."""
    own = F.filter(F.split(body, r"(?dm)^(?=##\s)"), lambda x: x.rlike(rf"(?dmi)\A##\s+{section}\s*$"))
    content = F.when(F.contains(body, F.lit("##")), F.get(own, F.lit(0)))
    items = F.transform(
        F.array(F.coalesce(content, F.lit(""))),
        lambda x: F.struct(F.regexp_extract_all(x, F.lit(r"(?dm)^\d+\.\s+(.+)$"), F.lit(1)).alias("numbered"), F.regexp_extract_all(x, F.lit(r"(?dm)^[-*]\s+(.+)$"), F.lit(1)).alias("bulleted")),
    )
    return F.transform(items, lambda x: F.when(F.size(x["numbered"]) > 0, x["numbered"]).otherwise(x["bulleted"]))[0]


def code_examples(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1))


def json_in_prose(text: Column) -> Column:
    """The JSON in an answer: a fenced block, or from the first ``{`` to the last ``}``, or the stripped text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    braces = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), text.substr(first, last - first + 1))
    return F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(fenced)).otherwise(F.coalesce(braces, strip(text)))


def template(text: str, **columns: Column) -> Column:
    """``$name`` and ``${name}`` replaced by columns, in one pass, so placeholders inside values stay; ``$$`` is a dollar sign and unknown names stay as they are."""
    parts: list[Column] = []
    at = 0
    for found in re.finditer(r"\$(?:(\$)|\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", text):
        parts.append(F.lit(text[at : found.start()]))
        name = found[2] or found[3]
        parts.append(F.lit("$") if found[1] else F.coalesce(columns[name].cast("string"), F.lit("")) if name in columns else F.lit(found[0]))
        at = found.end()
    return F.concat(*parts, F.lit(text[at:]))


def numbered_sections(items: Column, heading: str) -> Column:
    """Items under headings numbered from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(f"## {heading} "), (i + 1).cast("string"), F.lit("\n"), x)), "\n\n")


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def last_user_prompt(messages: Column, prompt: Column) -> Column:
    """The last user message's content, or else all messages as ``role: content`` lines, or else the prompt."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    every = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.when(F.size(users) > 0, F.element_at(users, -1)["content"]).when(F.size(messages) > 0, every).otherwise(prompt)


def last_part(path: Column) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def comma_list(text: Column) -> Column:
    """The parts of a comma-separated text, stripped."""
    return F.transform(F.split(text, ","), strip)


def first_lines(script: Column, most: int = 10) -> tuple[Column, Column]:
    """The first lines of a script, and how many more it has."""
    lines = F.split(script, "\n")
    return F.slice(lines, 1, most), F.greatest(F.size(lines) - most, F.lit(0))


def with_schema(prompt: Column, schema: str) -> Column:
    """A prompt that asks for JSON of a schema and nothing else."""
    return F.concat(prompt, F.lit(f"\n\nAnswer with one JSON object that this JSON schema accepts, and nothing else:\n{schema}"))


def cache_name(name: Column, is_path: Column) -> Column:
    """The name results are kept under: the last part of a name that is a path which is there, else the name as it is."""
    return F.when(is_path, last_part(name)).otherwise(name)
