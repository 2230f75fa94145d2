"""RE2 patterns (the reference's and DuckDB's dialect) to java.util.regex (Spark's).

A small rewrite plus lint on the driver. A pattern that RE2 would reject (or that
means something else in Java and cannot be rewritten) is reported invalid, and
the matchers skip it, as the reference skips patterns that do not compile.
"""

from __future__ import annotations

import re

# ASCII word boundary (RE2 \b is ASCII; Java's is Unicode-aware).
_W = "[0-9A-Za-z_]"
WORD_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
NOT_WORD_BOUNDARY = f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"
SPACE_CHARS = "\\t\\n\\f\\r "

# RE2 POSIX classes and their java.util.regex names (ASCII in both).
POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
         "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
         "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s\x0B", "upper": r"\p{Upper}",
         "word": r"\w", "xdigit": r"\p{XDigit}"}


class PatternError(ValueError):
    pass


def _prop(p: str, i: int):
    """Rewrite a Unicode property escape at p[i] ('\\p' or '\\P'); returns (java, next_i).

    RE2 names scripts bare (\\p{Greek}); Java wants \\p{IsGreek} (Is works for categories
    too). \\p{^X} is RE2's negation."""
    neg = p[i + 1] == "P"
    if i + 2 < len(p) and p[i + 2] == "{":
        j = p.find("}", i + 3)
        if j < 0:
            raise PatternError("bad property")
        name = p[i + 3:j]
        if name.startswith("^"):
            neg, name = not neg, name[1:]
        if name == "Any":
            return ("[\\x{0}-\\x{10FFFF}]" if not neg else "[^\\x{0}-\\x{10FFFF}]"), j + 1
        return ("\\P" if neg else "\\p") + "{Is" + name + "}", j + 1
    return p[i:i + 3], i + 3


def _flags_at(p: str, i: int):
    """Parse '(?flags)' or '(?flags:' at p[i]; returns (flags_on, flags_off, end, is_group)."""
    m = re.match(r"\(\?([imsU]*)(?:-([imsU]*))?([:)])", p[i:])
    if not m:
        return None
    return m.group(1), m.group(2) or "", i + m.end(), m.group(3) == ":"


def re2_to_java(p: str) -> str:
    """Rewrite an RE2 pattern for java.util.regex; raise PatternError if RE2 rejects it."""
    out = []
    i, n = 0, len(p)
    in_class = False
    class_start = False
    negated_class = False
    names = set()
    stack = []
    ungreedy = False
    dotall = False
    multiline = False
    while i < n:
        c = p[i]
        if in_class:
            if c == "\\":
                if i + 1 >= n:
                    raise PatternError("trailing backslash")
                d = p[i + 1]
                if d == "s":
                    out.append(SPACE_CHARS)
                elif d == "S":
                    if negated_class:
                        raise PatternError("\\S inside a negated class is not rewritten")
                    out.append("[^" + SPACE_CHARS + "]")  # a nested class is a union in Java
                elif d == "v":
                    out.append("\\x0B")
                elif d in "pP":
                    j, i = _prop(p, i)
                    out.append(j)
                    class_start = False
                    continue
                else:
                    j, i = _escape(p, i, "afnrtdDwW")
                    out.append(j)
                    class_start = False
                    continue
                i += 2
                class_start = False
                continue
            if c == "[" and p.startswith("[:", i):
                j = p.find(":]", i + 2)
                if j < 0:
                    raise PatternError("bad POSIX class")
                name = p[i + 2:j]
                neg = name.startswith("^")
                name = name[1:] if neg else name
                if name not in POSIX:
                    raise PatternError(f"unknown POSIX class {name}")
                cls = POSIX[name]
                if neg:
                    cls = "[^" + cls + "]"
                out.append(cls)
                i = j + 2
                class_start = False
                continue
            if c == "[":
                out.append("\\[")
            elif c == "&" and p.startswith("&&", i):
                out.append("&\\&")
                i += 2
                continue
            elif c == "]" and not class_start:
                out.append("]")
                in_class = False
            elif c == "]" and class_start:
                out.append("\\]")
            else:
                out.append(c)
            class_start = False
            i += 1
            continue
        # outside a class
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("trailing backslash")
            d = p[i + 1]
            if d == "b":
                out.append(WORD_BOUNDARY)
            elif d == "B":
                out.append(NOT_WORD_BOUNDARY)
            elif d == "s":
                out.append("[" + SPACE_CHARS + "]")
            elif d == "S":
                out.append("[^" + SPACE_CHARS + "]")
            elif d == "v":
                out.append("\\x0B")
            elif d in "pP":
                j, i = _prop(p, i)
                out.append(j)
                continue
            elif d == "Q":
                j = p.find("\\E", i + 2)
                lit = p[i + 2:] if j < 0 else p[i + 2:j]
                out.append("\\Q" + lit.replace("\\E", "\\E\\\\E\\Q") + "\\E")
                i = n if j < 0 else j + 2
                continue
            else:
                j, i = _escape(p, i, "afnrtdDwWAz")
                out.append(j)
                continue
            i += 2
            continue
        if c == "[":
            in_class = True
            class_start = True
            out.append("[")
            negated_class = p.startswith("[^", i)
            if negated_class:
                out.append("^")
                i += 2
            else:
                i += 1
            continue
        if c == ")":
            if stack:
                dotall, multiline, ungreedy = stack.pop()
            out.append(")")
            i += 1
            continue
        if c == "(":
            named = re.match(r"\(\?P?<([0-9A-Za-z_]+)>", p[i:])
            if named:  # names are not used, and Java does not take every RE2 name
                if named.group(1) in names:
                    raise PatternError("duplicate group name")
                names.add(named.group(1))
                stack.append((dotall, multiline, ungreedy))
                out.append("(")
                i += named.end()
                continue
            if p.startswith("(?=", i) or p.startswith("(?!", i) or p.startswith("(?<", i) or p.startswith("(?>", i):
                raise PatternError("lookaround / atomic groups are not RE2")
            if p.startswith("(?", i):
                f = _flags_at(p, i)
                if not f:
                    raise PatternError("unsupported group")
                on, off, end, is_group = f
                if is_group:  # (?flags:...) scopes the flags to the group
                    stack.append((dotall, multiline, ungreedy))
                dotall = (dotall or "s" in on) and "s" not in off
                multiline = (multiline or "m" in on) and "m" not in off
                ungreedy = (ungreedy or "U" in on) and "U" not in off
                on, off = on.replace("U", ""), off.replace("U", "")
                on2 = on.replace("m", "").replace("i", "iu") if "i" in on else on.replace("m", "")
                off2 = off.replace("m", "")
                if on2 or off2 or is_group:
                    out.append("(?" + on2 + ("-" + off2 if off2 else "") + (":" if is_group else ")"))
                i = end
                continue
            stack.append((dotall, multiline, ungreedy))
            out.append("(")
            i += 1
            continue
        rep = re.match(r"\{\d+(,\d*)?\}", p[i:]) if c == "{" else None
        if c in "*+?" or rep:
            q = rep.group(0) if rep else c
            i += len(q)
            if rep:
                least, _, most = q[1:-1].partition(",")
                if int(least) > 1000 or (most and (int(most) > 1000 or int(most) < int(least))):
                    raise PatternError("bad repeat count")
            lazy = i < n and p[i] == "?"
            if lazy:
                i += 1
            if i < n and (p[i] in "*+?" or re.match(r"\{\d+(,\d*)?\}", p[i:])):
                raise PatternError("a repetition of a repetition (possessive or nested) is not RE2")
            # RE2 (?U) swaps greedy and lazy
            out.append(q + ("?" if lazy != ungreedy else ""))
            continue
        if c == ".":
            out.append("." if dotall else "[^\\n]")
        elif c == "$":
            out.append("(?=\\n|\\z)" if multiline else "\\z")
        elif c == "^":
            out.append("(?:^|(?<=\\n))" if multiline else "^")
        elif c == "{" and not re.match(r"\{\d+(,\d*)?\}", p[i:]):
            out.append("\\{")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError("missing ]")
    return "".join(out)


def _escape(p: str, i: int, letters: str) -> tuple[str, int]:
    """The escape at ``i`` and the place after it; only escapes that RE2 knows pass."""
    d = p[i + 1]
    if d in letters:
        return p[i:i + 2], i + 2
    if d in "01234567":
        m = re.match(r"0[0-7]{0,2}|[1-7][0-7]{1,2}", p[i + 1:])
        if not m:
            raise PatternError("backreference")
        return "\\x{%x}" % int(m.group(0), 8), i + 1 + m.end()
    if d == "x":
        m = re.match(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})", p[i + 1:])
        if not m or int(m.group(1) or m.group(2), 16) > 0x10FFFF:
            raise PatternError("bad \\x escape")
        return "\\x{%s}" % (m.group(1) or m.group(2)), i + 1 + m.end()
    if d.isascii() and not d.isalnum():
        return p[i:i + 2], i + 2
    raise PatternError(f"\\{d} is not RE2")


def java_valid(spark, pattern: str) -> bool:
    """Compile on the driver's JVM (the executors run the same java.util.regex)."""
    try:
        jvm = spark.sparkContext._jvm
    except Exception:
        jvm = None
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(pattern)
            return True
        except Exception:
            return False
    try:  # no driver JVM handle: let Spark compile it on a one-row frame
        from pyspark.sql import functions as F
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
        return True
    except Exception:
        return False


def prepare(spark, pattern: str) -> str | None:
    """Java form of an RE2 pattern, or None when it must be skipped."""
    try:
        j = re2_to_java(pattern)
    except PatternError:
        return None
    return j if java_valid(spark, j) else None


_TAIL_ATOM = re.compile(r"(?:[^\\.\[\](){}*+?|^$]|\[\^?(?:\[:\^?[a-z]+:\]|[^\\\[\]&^])+\])(?:(\?)|\{(\d{1,3})(?:,(\d{1,3}))?\})?")


def free_of_context(p: str) -> bool:
    """Whether what RE2 pattern ``p`` matches depends on the matched characters only (no escapes, no anchors).

    Then its leftmost match begins where the matched characters first occur. Conservative.
    """
    return not re.search(r"[\\$]|(?<!\[)\^", p)


def literal_tail(p: str, lit: str, most: int = 64) -> tuple[str, int, bool] | None:
    """(pattern of ``lit`` and all behind it, characters that may match behind ``lit``, whether nothing is before it), or None.

    ``lit`` is the required literal of RE2 pattern ``p``. Every match of ``p`` holds a match of the returned
    pattern, so an occurrence of ``lit`` where it does not match is in no match. Conservative: only plain
    characters and classes, repeated at most ``most`` times in all, may stand behind ``lit``, and no escape anywhere.
    """
    if "\\" in p:
        return None
    k = p.rfind(lit)
    i, n = k + len(lit), 0
    if k < 0 or re.search(r"[.\[\](){}*+?|^$]", lit):
        return None
    while i < len(p):
        m = _TAIL_ATOM.match(p, i)
        if m is None:
            return None
        n += 1 if m[2] is None else int(m[3] or m[2])
        i = m.end()
    return (p[k:], n, k == 0) if n <= most else None


def required_literal(p: str) -> str | None:
    """The longest literal run every match of RE2 pattern ``p`` must contain, or None.

    Conservative: only top-level literals count (no alternation at the top, nothing
    inside groups or classes, an optional char drops out). Used as a cheap
    ``contains`` test in front of the regex: a text without the literal cannot match.
    """
    if re.search(r"\(\?[a-zA-Z]*i", p):
        return None
    runs, cur = [], []
    i, n, depth = 0, len(p), 0
    # reject top-level alternation
    j, d, in_cls = 0, 0, False
    while j < n:
        c = p[j]
        if c == "\\":
            j += 2
            continue
        if in_cls:
            if p.startswith("[:", j):
                e = p.find(":]", j + 2)
                j = n if e < 0 else e + 2
                continue
            in_cls = c != "]"
        elif c == "[":
            in_cls = True
            if p.startswith("[]", j) or p.startswith("[^]", j):
                j += 2
        elif c == "(":
            d += 1
        elif c == ")":
            d -= 1
        elif c == "|" and d == 0:
            return None
        j += 1

    def end_run():
        if cur:
            runs.append("".join(cur))
            cur.clear()

    while i < n:
        c = p[i]
        nxt = p[i + 1] if i + 1 < n else ""
        if c == "\\" and i + 1 < n:
            d = p[i + 1]
            if not d.isalnum():
                atom, i = d, i + 2
            elif d == "Q":
                k = p.find("\\E", i + 2)
                lit = p[i + 2:] if k < 0 else p[i + 2:k]
                i = n if k < 0 else k + 2
                q = p[i] if i < n else ""
                if q in "*?{":
                    end_run()
                    continue
                cur.extend(lit)
                if q == "+":
                    end_run()
                continue
            else:
                # class / assertion escapes; skip their argument too (\p{..}, \pL, \x{..}, \xhh, \0oo)
                end_run()
                i += 2
                if d in "pPx" and i < n and p[i] == "{":
                    k = p.find("}", i)
                    i = n if k < 0 else k + 1
                elif d in "pP":
                    i += 1
                elif d == "x":
                    i += 2
                elif d in "01234567":  # three octal digits at most, the first one is read
                    k = i + 2
                    while i < min(n, k) and p[i] in "01234567":
                        i += 1
                if i < n and p[i] in "*+?{":
                    continue
                continue
        elif c == "[":
            k = i + 1
            if p.startswith("^", k):
                k += 1
            if p.startswith("]", k):
                k += 1
            while k < n and p[k] != "]":
                if p.startswith("[:", k):
                    e = p.find(":]", k + 2)
                    k = n if e < 0 else e + 2
                    continue
                k += 2 if p[k] == "\\" else 1
            end_run()
            i = k + 1
            continue
        elif c == "(":
            k, d = i, 0
            while k < n:
                if p[k] == "\\":
                    k += 2
                    continue
                if p[k] == "(":
                    d += 1
                elif p[k] == ")":
                    d -= 1
                    if d == 0:
                        break
                k += 1
            end_run()
            i = k + 1
            continue
        elif c in ".^$":
            end_run()
            i += 1
            continue
        elif c in "*+?{":
            end_run()
            i += 1
            if c == "{":
                k = p.find("}", i)
                i = n if k < 0 else k + 1
            continue
        else:
            atom, i = c, i + 1
        q = p[i] if i < n else ""
        if q in ("*", "?") or (q == "{" and re.match(r"\{0", p[i:])):
            end_run()
            continue
        cur.append(atom)
        if q in ("+", "{"):
            end_run()
    end_run()
    best = max(runs, key=len, default="")
    return best or None


def nested_quantifier(p: str) -> bool:
    """True when a quantified group holds a quantifier, e.g. ``(a+)+``: linear in RE2,
    but java.util.regex may backtrack exponentially on it (a task could stall)."""
    stack, i, n, in_cls = [], 0, len(p), False
    while i < n:
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if in_cls:
            in_cls = c != "]"
        elif c == "[":
            in_cls = True
            if p.startswith("[]", i) or p.startswith("[^]", i):
                i += 2
        elif c == "(":
            stack.append(False)
        elif c == ")" and stack:
            inner = stack.pop()
            nxt = p[i + 1] if i + 1 < n else ""
            unbounded = nxt in "*+" or bool(re.match(r"\{\d+,\}", p[i + 1:]))
            if inner and unbounded:
                return True
            if stack:
                stack[-1] = stack[-1] or inner or nxt in "*+?{"
        elif c in "*+" or (c == "{" and re.match(r"\{\d+(,\d*)?\}", p[i:])):
            if stack:
                stack[-1] = True
        i += 1
    return False
