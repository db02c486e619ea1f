"""Scalar functions over questions, paths, source text and URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the intents, in the order in which they are tried on the lower-cased question, and the intent
# of a question that none fits.
INTENT_PATTERNS = [
    ("find-ownership", r"where\s+is|who\s+handles|which\s+service|what\s+is\s+responsible|who\s+owns"),
    ("trace-flow", r"how\s+does|what\s+happens\s+when|trace|walk\s+me|step\s+through|flow"),
    ("locate-logic", r"where\s+are|find\s+all|locate|show\s+me\s+all"),
    ("explain-deps", r"what\s+breaks|what\s+depends|what\s+imports|who\s+uses|what\s+calls"),
    ("explain-arch", r"explain|overview|architecture|describe|what\s+is\s+this|summarize"),
]
DEFAULT_INTENT = "explain-arch"

# Words that are no keywords.
STOP_WORDS = [
    "is", "are", "the", "a", "an", "in", "on", "at", "to", "for", "of",
    "and", "or", "how", "what", "where", "who", "which", "does", "do",
    "work", "handled", "responsible", "tell", "me", "give", "show", "this",
    "that", "if", "when", "by", "with", "can", "could", "would", "should",
]

# Languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "java": "java"}

# Framework hints as (language, substrings of which one must occur, framework, hint).
HINTS = [
    ("typescript", ["@nestjs/"], "nestjs", "@nestjs import detected"),
    ("typescript", ["@angular/"], "angular", "@angular import detected"),
    ("typescript", ["from 'react'", 'from "react"'], "react", "react import detected"),
    ("typescript", ["express"], "express", "express import detected"),
    ("python", ["fastapi", "FastAPI"], "fastapi", "FastAPI detected"),
    ("python", ["flask", "Flask"], "flask", "Flask detected"),
    ("python", ["django"], "django", "Django detected"),
    ("java", ["springframework"], "spring", "Spring import detected"),
    ("java", ["@Controller", "@RestController"], "spring", "Spring Controller"),
    ("java", ["@Service"], "spring", "Spring Service"),
]

MAX_CONTENT, PREVIEW_LINES, CLASS_PREVIEW = 2000, 50, 10
GITHUB = "^https://github\\.com/"


def intent(question: Column) -> Column:
    """the first intent whose pattern occurs in the question, whatever the case; null questions get the default."""
    q, out = F.lower(question), None
    for name, pattern in INTENT_PATTERNS:
        hit = q.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_INTENT)


def keywords(question: Column) -> Column:
    """lower-cased words of more than two ASCII letters or digits that are no stop words, in order, with repeats."""
    words = F.split(F.regexp_replace(F.lower(question), "[^a-z0-9\\s]", ""), "\\s+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Without the last segment; `.` for a bare name."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def extension(path: Column) -> Column:
    """F8: after the last dot of the base name, lower-cased; empty for none, and for a name whose only dot is its first character."""
    return F.lower(F.regexp_extract(basename(path), "^.+\\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """null for an unknown extension. `.cjs` is JavaScript for detector, diff and parser alike."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path))


def is_supported(path: Column) -> Column:
    """The suffix test is case-sensitive."""
    return path.rlike("\\.(" + "|".join(LANGUAGES) + ")$")


def node_type(path: Column, hints: Column) -> Column:
    """by the base name's suffix, then by a service framework among the hints."""
    name, out = basename(path), None
    for kind in ("controller", "service", "module"):
        hit = name.endswith(f".{kind}.ts") | name.endswith(f".{kind}.js")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(F.exists(F.coalesce(hints, F.array()), lambda h: h["framework"].isin("nestjs", "spring")), "service").otherwise("file")


def is_external(source: Column) -> Column:
    """F7."""
    return ~source.rlike("^[./]")


def normalise_path(path: Column) -> Column:
    """Resolves `.`, `..` and empty segments; `..` above the root of a relative path stays."""
    def push(stack: Column, part: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        pop = (part == "..") & top.isNotNull() & (top != "..")
        return F.when((part == "") | (part == "."), stack).when(pop, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), push), "/")


def resolve_import(from_path: Column, source: Column) -> Column:
    """the repository-relative path that a relative import names."""
    return normalise_path(F.concat(dirname(from_path), F.lit("/"), source))


def ast_name(path: Column) -> Column:
    """slashes of either kind become dashes, one leading dash goes."""
    return F.regexp_replace(F.regexp_replace(path, "[/\\\\]", "-"), "^-", "")


def repo_dir(root: str, repository: Column, *parts: str) -> Column:
    """F10."""
    return F.concat_ws("/", F.lit(root), repository, *map(F.lit, parts))


def relative_path(path: Column, root: Column) -> Column:
    """path below root; another path as it is."""
    base = F.regexp_replace(root, "/+$", "")
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def content_hash(content: Column) -> Column:
    """of bytes or text."""
    return F.sha2(content.cast("binary"), 256)


def line_slice(source: Column, start: Column, end: Column, most: int = MAX_CONTENT) -> Column:
    """lines start to end, counted from 1 and both included, cut to `most` characters."""
    first = F.greatest(start, F.lit(1))
    return F.substring(F.array_join(F.slice(F.split(source, "\n"), first, F.greatest(end - first + 1, F.lit(0))), "\n"), 1, most)


def file_preview(source: Column, lines: int = PREVIEW_LINES, most: int = MAX_CONTENT) -> Column:
    """the first lines, cut to `most` characters."""
    return F.substring(F.array_join(F.slice(F.split(source, "\n"), 1, lines), "\n"), 1, most)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def class_preview_end(start: Column, end: Column) -> Column:
    """F20."""
    return F.least(start + CLASS_PREVIEW, end)


def embed_text(name: Column, content: Column) -> Column:
    """F22."""
    return F.concat_ws("\n", name, content)


def framework_hints(language_: Column, source: Column) -> Column:
    """JavaScript has the hints of TypeScript."""
    family = F.when(language_ == "javascript", "typescript").otherwise(language_)
    found = [F.when((family == lang) & _any(source, words), F.struct(F.lit(framework).alias("framework"), F.lit(hint).alias("hint"))) for lang, words, framework, hint in HINTS]
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def _any(source: Column, words: list[str]) -> Column:
    out = source.contains(words[0])
    for w in words[1:]:
        out = out | source.contains(w)
    return out


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    """F25."""
    return F.concat(kind, F.lit(":"), source, F.lit("->"), target)


def repo_name(url: Column) -> Column:
    """the last segment of a URL without `.git`."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), "\\.git$", "")


def zip_name(path: Column) -> Column:
    """the base name without `.zip`."""
    return F.regexp_replace(basename(path), "\\.zip$", "")


def pr_parts(url: Column) -> Column:
    """F16: struct(owner, repo, number) of a pull request's URL; null where it is none."""
    shape = "github\\.com/([^/]+)/([^/]+)/pull/(\\d+)"
    return F.when(url.rlike(shape), F.struct(F.regexp_extract(url, shape, 1).alias("owner"), F.regexp_extract(url, shape, 2).alias("repo"), F.regexp_extract(url, shape, 3).cast("int").alias("number")))


def repo_parts(url: Column) -> Column:
    """F16: struct(owner, repo) of a repository's URL; the name stops at the first dot or slash; null where it is none."""
    shape = "github\\.com/([^/]+)/([^/.]+)"
    return F.when(url.rlike(shape), F.struct(F.regexp_extract(url, shape, 1).alias("owner"), F.regexp_extract(url, shape, 2).alias("repo")))


def may_carry_token(url: Column) -> Column:
    """F34."""
    return F.coalesce(url.rlike(GITHUB), F.lit(False))


def tracked_ref(tracked: Column, default: Column) -> Column:
    """F33."""
    return F.concat(F.lit("refs/heads/"), F.coalesce(tracked, default, F.lit("main")))


def duration_label(ms: Column) -> Column:
    """`Nms` below a second, else `N.Ns`; a dash for null."""
    return F.when(ms.isNull(), "—").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms.cast("double") / 1000))


def age_label(then: Column, now: Column) -> Column:
    """whole seconds below a minute, minutes below an hour, else hours."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))


def preview(text: Column, most: int = 60) -> Column:
    """P18."""
    return F.substring(text, 1, most)


def shown_metadata(metadata: Column) -> Column:
    """The entries of a map that are neither null nor empty."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull() & (v != ""))


def metadata_path(metadata_json: Column) -> Column:
    """filePath, else path, else empty; also for what is no JSON object."""
    return F.coalesce(F.get_json_object(metadata_json, "$.filePath"), F.get_json_object(metadata_json, "$.path"), F.lit(""))
