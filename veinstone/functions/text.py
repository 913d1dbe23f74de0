"""Text expressions of ingest, guards and annotation; built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and thresholds that results depend on.
TOKEN = r"[a-z0-9][a-z0-9._+:-]*"
HANZI = r"[\x{4e00}-\x{9fff}]"
WHITE = r"[\s\x1c-\x1f]"  # with (?U)
LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
LINK_LINE = r"(?iU)^(?:[-*]\s+)?(?:https?://|\[[^\]]+\]\(https?://)"
BLOB_LINE = r"^[A-Za-z0-9+/]{62,}={0,2}$"
WORD = r"\p{L}\p{N}_"
REDACTIONS = [
    (r"(?is)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "<REDACTED_PRIVATE_KEY>"),
    (rf"(?iU)(?<![{WORD}])((?:authorization\s*:\s*bearer|bearer)\s+)[A-Za-z0-9._~+/=-]{{8,}}", "$1<REDACTED>"),
    (rf"(?iU)(?<![{WORD}])((?:api[_-]?key|secret[_-]?key|access[_-]?token|token|password|passwd|cookie)\s*[:=]\s*[\"']?)([^\s\"']{{4,}})", "$1<REDACTED>"),
]
NOISE = [(r"(?s)<!--.*?-->", ""), (r"(?s)\{\{#ref\}\}\n.*?\n\{\{#endref\}\}\n?", ""), (r"\{\{#[a-z-]+(?:[^{}]*)\}\}\n?", ""), (r"\[([^\]]*)\]\((?=[^)]*\.md(?:#|\?|\)|$))[^)]*\)", "$1"), (r"\n{4,}", "\n\n\n")]
GLIBC = rf"(?i)(?=[gl])(?<![{WORD}])(?:g?libc)[\s\-_]*(2\.\d{{1,2}})(?![{WORD}])"
CVE = rf"(?i)(?=c)(?<![{WORD}])(CVE-\d{{4}}-\d{{4,7}})(?![{WORD}])"
ARCHITECTURES = {
    "amd64": r"x86[_-]?64|amd64", "i386": r"i[3-6]86|x86(?![{w}])(?![\s_-]?64)", "arm64": r"arm64|aarch64", "arm": r"arm(?:v[3-8][{w}]*|el|hf)",
    "mips": r"mips[{w}]*", "windows": r"windows|win32|win64", "macos": r"macos|osx|darwin", "linux": r"linux",
}
# The letters that a name's matches begin with, and lower-case strings of which every match holds one: cheap looks before the pattern.
HINTS = {
    "amd64": ("xa", "x86", "amd64"), "i386": ("ix", "86"), "arm64": ("a", "arm64", "aarch64"), "arm": ("a", "arm"),
    "mips": ("m", "mips"), "windows": ("w", "windows", "win32", "win64"), "macos": ("mod", "macos", "osx", "darwin"), "linux": ("l", "linux"),
}
FLAG = rf"(?<!\\)(?<![{WORD}])([A-Za-z][A-Za-z0-9_]{{1,23}})\{{([^{{}}\n]{{8,120}})\}}"
FLAG_BODY = r"^[A-Za-z0-9_!@#$%^&*\-+=:.?~]{8,}$"
CODE_WORDS = (
    "if else elif for while switch case catch finally try do return function func def class struct union enum template namespace foreach with lambda match default import from new "
    "let var const identifier printf sprintf format echo select insert update delete where table index create alter values print range input output begin end text label ref cite "
    "section sleep success error debug info warn trace stdout"
)
FENCE = r"(?ms)^[ \t]*(`{3,}|~{3,})[ \t]*([^\n`]*?)\r?\n(.*?)(?:^[ \t]*\1[ \t]*\r?$)"
RUNNABLE = (
    "python py bash sh shell zsh powershell ps1 cmd c cpp c++ csharp java javascript js typescript ts php ruby rb perl go rust sql lua asm nasm http yaml yml json xml ini conf dockerfile makefile"
)
RUNNABLE_BODY = (
    r"(?im)^\s*(?:\$|#|>|PS[ >])|curl\s|wget\s|nc\s+-|ncat\s|python[23]?\s+-c|perl\s+-e|ruby\s+-e|import\s+\w+|from\s+\w+\s+import|(?:get|post|put|delete)\s+/[^\s]*\s+HTTP/|"
    r"[\w./-]+\.(?:py|sh|rb|pl|go|c|cpp|java|php)\b"
)
IMAGE_LINK = r"!\[([^\]]*)\]\(\s*<?([^\s)>\x22\x27]*)>?(?:\s+[\x22\x27][^\x22\x27]*[\x22\x27])?\s*\)"
IMAGE_TAG = r"(?i)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"'][^>]*>"
PROVENANCE = "source_repository source_url source_path source_commit retrieved_at usage notice".split()
HEAD = r"(?s)\A---\n(.{0,4092}?)\n---\n"
ORIGINS = {"08_ctf_des_knowledge": "handbook", "09_hacktricks": "handbook", "10_payloads_all_the_things": "handbook", "11_lolbas": "handbook", "12_security_learning": "blog-mirror", "13_xianzhi": "blog-mirror", "15_butian": "blog-mirror", "14_ctf_wp": "writeup"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def path(source: Column) -> Column:
    return F.translate(source, "\\", "/")


def tokens(text: Column) -> Column:
    """Tokens of two characters or more, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbours inside each run of Hanzi."""
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(HANZI + "{2,}"), F.lit(0)), pairs)))


def query_terms(text: Column) -> Column:
    """Tokens, then bigrams, each with whether it must stand alone; null for a blank query."""
    as_terms = lambda words, alone: F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(alone).alias("alone")))
    return F.when(F.trim(text) != "", F.concat(as_terms(tokens(text), True), as_terms(bigrams(text), False)))


def identifiers(text: Column) -> Column:
    """Distinct tokens of four characters or more that hold a digit."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) >= 4) & t.rlike("[0-9]")))


def strip_images(text: Column) -> Column:
    """Image marks give way to their trimmed names."""
    return F.regexp_replace(text, rf"(?U)!\[{WHITE}*([^\]]*?){WHITE}*\]\([^)]*\)", "$1")


def screenshots(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(IMAGE)), F.lit(0)).cast("long")


def redact(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, *r), REDACTIONS, text)


def strip_noise(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, *r), NOISE, text)


def low_information(text: Column) -> Column:
    """Reasons, in a fixed order, for which a text says too little; a null or blank text is just empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, f"(?U){WHITE}", "")
    lines = F.filter(F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(x, rf"(?U)^{WHITE}+|{WHITE}+$", "")), lambda x: x != "")
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    blobs = F.size(F.filter(lines, lambda x: (F.length(x) >= 64) & x.rlike(BLOB_LINE)))
    reason = lambda name, c: F.when(c, F.lit(name))
    found = F.array_compact(F.array(
        # a text's first characters tell it mostly; all are looked at if these are few
        reason("repetitive", (F.length(bare) >= 120) & (F.size(F.array_distinct(F.split(F.left(bare, F.lit(240)), ""))) <= 12) & (F.size(F.array_distinct(F.split(bare, ""))) <= 12)),
        reason("sparse", (F.length(text) >= 200) & (F.length(bare) < 0.15 * F.length(text))),
        reason("numeric", (F.length(text) >= 100) & ~text.rlike(rf"[A-Za-z]|{HANZI}")),
        reason("link-heavy", (F.size(lines) > 0) & (count(LINK_LINE) / F.size(lines) >= 0.6)),
        reason("no-text", ~text.rlike(rf"[0-9A-Za-z]|{HANZI}")),
        reason("blob-heavy", (F.size(lines) >= 3) & (blobs / F.size(lines) >= 0.5)),
    ))
    return F.when(bare == "", F.array(F.lit("empty"))).otherwise(found)


def facts(text: Column, limit: int = 6) -> Column:
    """Versions, CVE numbers and architectures that a text names; a kind that it doesn't name is null."""
    text = F.coalesce(text, F.lit(""))
    some = lambda found: let(found, lambda xs: F.when(F.size(xs) > 0, xs))
    minor = lambda v: F.substring_index(v, ".", -1).cast("int")
    glibc = F.transform(F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(GLIBC), F.lit(1))), lambda v: F.struct(minor(v).alias("n"), v.alias("v")))), lambda s: s["v"])
    cve = F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CVE), F.lit(1)), F.upper))), 1, limit)
    hinted = lambda low, name: reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in HINTS[name][1:]])
    named = lambda name, p: text.rlike(rf"(?i)(?=[{HINTS[name][0]}])(?<![{WORD}])(?:{p.replace('{w}', WORD)})(?![{WORD}])")
    arch = let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(hinted(low, name) & named(name, p), F.lit(name)) for name, p in ARCHITECTURES.items()])))
    return F.struct(some(glibc).alias("glibc"), some(cve).alias("cve"), some(arch).alias("arch"))


def flags(text: Column, limit: int = 6) -> Column:
    """The first flags of past events, without code and prose that look like them."""
    text = F.coalesce(text, F.lit(""))
    code = F.array(*map(F.lit, CODE_WORDS.split()))
    prefix = lambda x: F.substring_index(x, "{", 1)  # noqa: E731  neither it nor the body holds a brace
    body = lambda x: F.substring_index(F.substring_index(x, "{", -1), "}", 1)
    kept = F.filter(F.regexp_extract_all(text, F.lit(FLAG), F.lit(0)), lambda x: ~F.array_contains(code, F.lower(prefix(x))) & body(x).rlike(FLAG_BODY) & ~body(x).rlike("^[a-z]+$"))
    return F.slice(F.array_distinct(kept), 1, limit)


def segments(text: Column, kind: str = "code", limit: int = 8) -> Column:
    """Fenced blocks (language, text) in order; kind payload keeps those that look runnable."""
    text = F.coalesce(text, F.lit(""))
    label, body = (F.regexp_extract_all(text, F.lit(FENCE), F.lit(i)) for i in (2, 3))
    named = F.transform(F.arrays_zip(label.alias("l"), body.alias("b")), lambda x: F.struct(F.nullif(F.lower(F.regexp_extract(x["l"], r"\S+", 0)), F.lit("")).alias("language"), F.regexp_replace(x["b"], r"[\r\n]+\z", "").alias("text")))
    kept = F.filter(named, lambda x: F.regexp_replace(x["text"], f"(?U){WHITE}", "") != "")
    if kind == "payload":
        listed = F.array(*map(F.lit, RUNNABLE.split()))
        kept = F.filter(kept, lambda x: F.coalesce(F.array_contains(listed, x["language"]), F.lit(False)) | x["text"].rlike(RUNNABLE_BODY))
    elif kind != "code":
        raise ValueError(f"unknown kind of segment: {kind}")
    return F.slice(kept, 1, limit)


def safe_target(src: Column) -> Column:
    """The address of an image if it is relative or http(s); otherwise null."""
    src = F.regexp_replace(src, rf"(?U)^{WHITE}+|{WHITE}+$", "")
    odd = (src == "") | src.rlike("[ \\t\\r\\n\"'<>]") | (src.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:") & ~src.rlike("(?i)^https?://"))
    return F.when(~odd, src)


def images(text: Column) -> Column:
    """Images (src, alt) that a text embeds: marks, then tags; the first of each address."""
    text = F.coalesce(text, F.lit(""))
    trim = lambda x: F.regexp_replace(x, rf"(?U)^{WHITE}+|{WHITE}+$", "")
    part = lambda x, i: F.regexp_extract(x, IMAGE_LINK, i)
    marks = F.transform(F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(0)), lambda x: F.struct(safe_target(part(x, 2)).alias("src"), trim(part(x, 1)).alias("alt")))
    tags = F.transform(F.regexp_extract_all(text, F.lit(IMAGE_TAG), F.lit(1)), lambda s: F.struct(safe_target(s).alias("src"), F.lit("").alias("alt")))
    first = lambda every: F.transform(F.array_distinct(F.transform(every, lambda x: x["src"])), lambda s: F.filter(every, lambda x: x["src"] == s)[0])
    return let(F.filter(F.concat(marks, tags), lambda x: x["src"].isNotNull()), lambda every: F.filter(first(every), lambda x: x.isNotNull()))


def _fields(text: Column) -> Column:
    """Known fields (key, value) of a leading block, in order, but for empty ones."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), HEAD, 1)
    known = F.array(*map(F.lit, PROVENANCE))
    pairs = F.transform(F.filter(F.split(head, LINE_END), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return F.filter(pairs, lambda p: F.array_contains(known, p["key"]) & (p["value"] != ""))


def provenance(text: Column) -> Column:
    """Known fields of a leading block of provenance, as a map; null without any known key."""
    known = F.array(*map(F.lit, PROVENANCE))
    last = lambda kept: F.map_from_entries(F.filter(F.transform(known, lambda k: F.struct(k.alias("key"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(kept, lambda p: p["key"] == k), lambda p: p["value"])), -1).alias("value"))), lambda p: p["value"].isNotNull()))
    return let(_fields(text), lambda kept: F.when(F.size(kept) > 0, last(kept)))


def strip_provenance(text: Column) -> Column:
    """The text without a leading block that has a known field, and without the line ends behind it."""
    return F.when(F.size(_fields(text)) > 0, F.regexp_replace(text, HEAD + r"\n*", "")).otherwise(text)


def strip_front_matter(text: Column) -> Column:
    """The text without any leading block."""
    return F.regexp_replace(text, HEAD + r"\n*", "")


def provenance_header(source_path: Column, commit: str, retrieved_at: str, repository: str, url: str | None = None) -> Column:
    # The keys, their order and the two closing sentences.
    lines = ["---", f"source_repository: {repository}", *([f"source_url: {url}"] if url else [])]
    tail = [f"source_commit: {commit}", f"retrieved_at: {retrieved_at}", "usage: authorized-lab-ctf-defense-research-only", "notice: Imported text is for authorized systems, isolated labs, CTFs, and defensive research.", "---", "", ""]
    return F.concat(F.lit("\n".join(lines) + "\nsource_path: "), source_path, F.lit("\n" + "\n".join(tail)))


def origin(source: Column) -> Column:
    """What kind of place a source's first segment is."""
    first = F.substring_index(path(source), "/", 1)
    known = reduce(lambda c, kv: c.when(first == kv[0], F.lit(kv[1])), ORIGINS.items(), F.when(F.lit(False), F.lit("")))
    return F.coalesce(known, F.when(first.rlike("^[0-9]{2}") & (F.try_to_number(F.substring(first, 1, 2), F.lit("99")) < 8), F.lit("curated")))


def decoded(content: Column) -> Column:
    """Bytes as text, without a byte order mark; what isn't UTF-8 becomes the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")
