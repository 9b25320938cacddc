"""Scalar operators on text as pure Column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS_BYTES = 96
CPP_PREFIX = 8192

# Fragments that mark a header as C++.
CPP_MARKS = ["::", "namespace", "template<", "template <", "class ", "public:", "private:", "protected:", "virtual ", "nullptr", "using namespace", 'extern "C"', "std::"]


def split_lines(text: Column) -> Column:
    """Lines ended by LF, CR or CRLF, without their ends; no empty line after a final end. Empty text has none."""
    parts = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def escape_address(line: Column) -> Column:
    r"""Backslash before each of \ / ^ $."""
    return F.regexp_replace(line, r"([\\/^$])", r"\\$1")


def full_address(line: Column) -> Column:
    return F.concat(F.lit("/^"), escape_address(line), F.lit('$/;"'))


def truncated(text: Column, size: int = ADDRESS_BYTES) -> Column:
    """The longest prefix of whole characters in at most ``size`` bytes of UTF-8."""
    body = F.encode(text, "utf-8")
    tries = [F.substring(body, 1, n) for n in range(size, max(0, size - 4), -1)]
    cut = F.coalesce(*(F.when(F.is_valid_utf8(t.cast("string")), t.cast("string")) for t in tries), F.lit(""))
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)


def truncated_address(line: Column) -> Column:
    """Escaped first and then cut, so that a cut may fall behind a backslash. Only a whole line is anchored at its end."""
    text = escape_address(line)
    return F.concat(F.lit("/^"), truncated(text), F.when(F.octet_length(text) <= ADDRESS_BYTES, F.lit('$/;"')).otherwise(F.lit('/;"')))


def query_address(line: Column) -> Column:
    """Address of a rule-found tag: as truncated_address of the line without trailing space, and a tab."""
    return F.concat(truncated_address(F.rtrim(line)), F.lit("\t"))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty for none and for names that begin with their only dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def byte_text(text: Column) -> Column:
    """A text with a character for each byte of its UTF-8, for patterns that count in bytes."""
    return F.decode(F.encode(text, "utf-8"), "iso-8859-1")


def _byte_class(members: set[int]) -> str:
    """A regex class of bytes; one without members matches nothing."""
    return "[" + "".join(f"\\x{b:02x}" for b in sorted(members)) + "]" if members else "(?!)"


def glob_regex(pattern: str) -> str:
    """A shell name pattern as an anchored regex over ``byte_text``.

    ``?`` and classes take one byte. ``[`` without an end is itself, ``]`` may be a class's
    first member, ``[!`` and ``[^`` negate, and a range that runs backwards has no members.
    """
    p, out, i = pattern.encode(), [], 0
    every = set(range(256))
    while i < len(p):
        c = p[i : i + 1]
        i += 1
        if c == b"*":
            out.append(r"[\x00-\xff]*")
        elif c == b"?":
            out.append(r"[\x00-\xff]")
        elif c == b"[":
            negate = p[i : i + 1] in (b"!", b"^")
            start = i + negate
            end = p.find(b"]", start + 1)
            if end < 0:
                out.append(r"\[")
                continue
            members, j = set(), start
            while j < end:
                if j + 2 < end and p[j + 1 : j + 2] == b"-":
                    members.update(range(p[j], p[j + 2] + 1))
                    j += 3
                else:
                    members.add(p[j])
                    j += 1
            out.append(_byte_class(every - members if negate else members))
            i = end + 1
        else:
            out.append(c.decode() if c.isalnum() else f"\\x{c[0]:02x}")
    return r"\A" + "".join(out) + r"\z"


def glob_match(name: Column, pattern: str) -> Column:
    return byte_text(name).rlike(glob_regex(pattern))


def exclude_regex(pattern: str) -> str:
    """An exclude pattern as an unanchored regex: ``*`` and ``?`` are wild, dots are dots, other regex characters stay live."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(c + pattern[i + 1])
            i += 2
            continue
        if inside:
            out.append(c)
            inside = c != "]"
        elif c == "[":
            out.append(c)
            inside = True
        else:
            out.append({"*": ".*", "?": ".", ".": r"\."}.get(c, c))
        i += 1
    return "".join(out)


def excluded(path: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.greatest(F.lit(False), *(path.rlike(exclude_regex(p)) for p in patterns))


def shebang_interpreter(head: Column) -> Column:
    """Interpreter named by a first line ``#!...``, looking through ``env`` and its options; null without one."""
    line = F.regexp_extract(head, r"\A#!([^\r\n]*)", 1)
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    first = F.regexp_extract(F.try_element_at(words, F.lit(1)), r"[^/\\]*$", 0)
    rest = F.filter(F.slice(words, 2, 1_000), lambda w: ~w.startswith("-") & ~w.contains("="))
    name = F.when(first == "env", F.regexp_extract(F.try_element_at(rest, F.lit(1)), r"[^/\\]*$", 0)).otherwise(first)
    return F.when(F.length(name) > 0, name)


def strip_version(name: Column) -> Column:
    return F.regexp_replace(name, r"[0-9.]+$", "")


def looks_like_cpp(content: Column) -> Column:
    """Whether a mark stands in the first CPP_PREFIX bytes."""
    head = lossy_text(F.substring(content.cast("binary"), 1, CPP_PREFIX))
    return F.greatest(*(head.contains(m) for m in CPP_MARKS))


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    one = lambda i: F.ascii(F.decode(F.substring(F.encode(text, "utf-8"), i, F.lit(1)), "iso-8859-1"))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), one)
    return F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).when(F.octet_length(text) > 0, values)


def djb2_hex(name: Column) -> Column:
    """Bernstein's hash modulo 2**32 over the bytes of the name, 8 hex digits."""
    h = F.aggregate(byte_values(name), F.lit(5381).cast("long"), lambda a, b: F.pmod(a * 33 + b, F.lit(4294967296)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def fnv_hex(name: Column) -> Column:
    """64-bit FNV-1a over the bytes of the name, 16 hex digits.

    The hash is held in two halves of 32 bits, whose products with the prime 2**40 + 435 do
    not wrap: ANSI arithmetic refuses 64-bit products that do.
    """
    half = 1 << 32

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b.cast("long"))
        high = h["high"] * 435 + F.shiftright(low * 435, 32) + low * 256
        return F.struct((high % half).alias("high"), (low * 435 % half).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    part = lambda n: F.lpad(F.hex(n), 8, "0")
    return F.aggregate(byte_values(name), start, step, lambda h: F.lower(F.concat(part(h["high"]), part(h["low"]))))


def escape_identifier(text: Column) -> Column:
    r"""A string literal's content as a tag name: trimmed at the end, control characters and a leading space or ! escaped."""
    t = F.rtrim(text)
    for raw, to in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        t = F.replace(t, F.lit(raw), F.lit(to))
    return F.when(t.startswith(" "), F.concat(F.lit("\\x20"), F.substring(t, 2, 1 << 30))).when(t.startswith("!"), F.concat(F.lit("\\x21"), F.substring(t, 2, 1 << 30))).otherwise(t)


def to_bool(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("yes", "on", "true", "1"), True).when(low.isin("no", "off", "false", "0"), False)


def access_level(name: Column, kind: Column) -> Column:
    return F.when(kind == "l", "private").when(name.startswith("_") & ~name.endswith("__"), "protected").otherwise("public")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def include_name(text: Column) -> Column:
    return F.btrim(text, F.lit('"<>'))


def operator_name(name: Column) -> Column:
    return F.when((F.length(name) > 8) & name.startswith("operator"), F.regexp_replace(name, r"^operator(?! )", "operator ")).otherwise(name)


def name_reference(module: Column, name: Column) -> Column:
    return F.when((module == "") | (module == "."), F.concat(F.lit("unknown:"), name)).otherwise(F.concat(F.lit("module:"), module, F.lit("."), name))


def scope_path(parts: Column, joint: str) -> Column:
    return F.array_join(parts, joint)


def ext_globs(extensions: Column) -> Column:
    return F.array_join(F.transform(extensions, lambda e: F.concat(F.lit("*."), e)), ", ")


def lossy_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def version_parts(version: Column) -> Column:
    """major, minor, patch, is_release, pre of a semantic version; null where it is none."""
    rx = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda i: F.regexp_extract(version, rx, i)
    # numbers come before words and are compared as numbers; of two lists that begin alike the shorter comes first
    number = lambda x: x.rlike("^[0-9]+$")
    identifier = lambda x: F.struct((~number(x)).alias("word"), F.when(number(x), x.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(number(x), "").otherwise(x).alias("text"))
    pre = F.transform(F.split(part(4), r"\."), identifier)
    return F.when(version.rlike(rx), F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (part(4) == "").alias("is_release"), pre.alias("pre")))


def version_status(installed: Column, available: Column) -> Column:
    a, b = version_parts(installed), version_parts(available)
    return F.when(installed.isNull(), "available").when(a < b, "update available").otherwise("installed")


def asset_url(base: Column, *parts: Column) -> Column:
    return F.concat_ws("/", F.rtrim(F.regexp_replace(base, "/+$", "")), *parts)


def markdown_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table, where a bar would end it."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def json_escaped(text: Column) -> Column:
    """Text for between the quotes of a JSON string: backslashes and quotes are marked."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
