"""Regular expressions with ECMAScript meaning for Spark's Java engine.

Java's \\b knows Unicode letters and its \\s doesn't know no-break spaces; ECMAScript is the other way about in both.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A boundary between an ASCII word character and anything else.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What ECMAScript's \s takes, for use inside and outside of brackets.
SPACES = r"\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def js(pattern: str, ignore_case: bool = False) -> str:
    """pattern with ECMAScript's \\b and \\s (outside of brackets)."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i : i + 2]
        if c == r"\b" and not inside:
            out.append(EDGE)
        elif c == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif c[0] == "\\":
            out.append(c)
        else:
            inside = (inside or c[0] == "[") and c[0] != "]"
            out.append(c[0])
            i -= 1
        i += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


def _begins_words(rest: str) -> bool:
    """Whether whatever matches here begins with an ASCII word character: a letter, or a group whose alternatives all do."""
    if not rest.startswith("("):
        return rest[:1].isascii() and rest[:1].isalnum() and rest[1:2] not in ("?", "*", "{")
    rest = rest.removeprefix("(?:") if rest.startswith("(?:") else rest[1:]
    depth, begin = 0, True
    for i, c in enumerate(rest):
        if begin and depth == 0 and not (c.isascii() and c.isalnum()):
            return False
        begin = depth == 0 and c == "|"
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return rest[i + 1 : i + 2] not in ("?", "*")
    return False


def low(pattern: str) -> str:
    """pattern with ECMAScript's meaning, without regard to case, for text that is in lower case.

    An edge before a word needs to look back only: that is tried at every place of a text.
    """
    out, i = "", 0
    while i < len(pattern):
        n = 1 if pattern[i] != "\\" else pattern.index("}", i) + 1 - i if pattern[i : i + 3] in (r"\p{", r"\x{") else 2
        out += pattern[i].lower() if n == 1 else pattern[i : i + n]
        i += n
    parts = out.split(r"\b")
    return js(parts[0]) + "".join(("(?<![A-Za-z0-9_])" if _begins_words(p) else EDGE) + js(p) for p in parts[1:])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, null where there is none (regexp_extract gives an empty string there)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def fold_accents(c: Column) -> Column:
    """Lower case without accents, for the letters of Western European languages."""
    plain = F.regexp_replace(F.lower(c), r"\p{M}", "")
    return F.translate(plain, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]
