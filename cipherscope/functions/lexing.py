"""Where comments and literals of a source file lie: one pass over its bytes that stops only where one may begin.

Each language has its own modes. Code inside an interpolated literal (template, f-string, ``$"..."``) is code again: the
literal is laid on a stack until the braces of the hole are closed. What is not closed on its line, where the language asks
for that, is no literal.
"""

from __future__ import annotations

import re

COMMENT, STRING, PART = 0, 1, 2
C_LIKE = ("c", "cpp", "java", "csharp", "javascript", "typescript", "go", "rust")
_LINE = {q: re.compile(rb"(?:[^\\\n%s]|\\.)*%s" % (q, q), re.S) for q in (b'"', b"'")}
_TRIPLE = {q: re.compile(rb"(?:[^\\]|\\.)*?" + q, re.S) for q in (b'"""', b"'''")}
_MULTI = re.compile(rb'(?:[^\\"]|\\.)*"', re.S)
_VERBATIM = re.compile(rb'(?:[^"]|"")*"', re.S)
_CHARACTER = re.compile(rb"(?:\\(?:u\{[^}\n]*\}|x..|.)|[^\\'\n\x80-\xff]|[\xc0-\xff][\x80-\xbf]+)'")
_RAW_CPP = re.compile(rb'([^()\\\s]{0,16})\(.*?\)\1"', re.S)
_REGEX = re.compile(rb"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NESTED = re.compile(rb"/\*|\*/")
_DOUBLED = re.compile(rb'"{3,}')
#: The text of an interpolated literal up to its end or its next hole, by closing quote.
_TEMPLATE = re.compile(rb"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_FORMATTED = {q: re.compile(rb"(?:[^\\{%s\n]|\\.|\{\{)*" % q, re.S) for q in (b'"', b"'")} | {q: re.compile(rb"(?:[^\\{%s]|\\.|\{\{|%s(?!%s))*" % (q[:1], q[:1], q[1:]), re.S) for q in (b'"""', b"'''")}
_INTERPOLATED = re.compile(rb'(?:[^"\\{\n]|\\.|\{\{)*', re.S)
_INTERPOLATED_VERBATIM = re.compile(rb'(?:[^"{]|""|\{\{)*', re.S)
_STARTS = {"python": rb"\"'#", "go": rb"\"'`/", "javascript": rb"\"'`/", "typescript": rb"\"'`/"}
_START = {lang: re.compile(rb"[%s]" % _STARTS.get(lang, rb"\"'/")) for lang in (*C_LIKE, "python")}
_START_INSIDE = {lang: re.compile(rb"[{}%s]" % _STARTS.get(lang, rb"\"'/")) for lang in (*C_LIKE, "python")}
_PREFIX = re.compile(rb"(?<![\w@$#])[\w@$]{0,3}#*\Z")
_PREFIXING = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_@$#")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = re.compile(rb"(?:^|[^\w$.])(?:return|typeof|case|in|of|delete|void|instanceof|new|do|else|yield|await|throw)\Z")


def _before_is_value(data: bytes, at: int, spans: list) -> bool:
    """Whether what stands before ``at``, but for blanks and comments, ends a value (so a slash divides it)."""
    k = len(spans)
    while at:
        if k and spans[k - 1][1] == at:
            k -= 1
            if spans[k][2] != COMMENT:
                return True
            at = spans[k][0]
        elif data[at - 1] in b" \t\r\n":
            at -= 1
        else:
            break
    if not at or not (data[at - 1 : at].isalnum() or data[at - 1] in b"_$)]"):
        return False
    return not _BEFORE_REGEX.search(data, max(0, at - 12), at)


def literals(data: bytes, lang: str) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, kind, start and stop of the body), in order. STRING is a whole literal, PART a piece of an
    interpolated one or a regular expression."""
    out: list[tuple[int, int, int, int, int]] = []
    lang = lang if lang in _START else "java"
    start, inside = _START[lang], _START_INSIDE[lang]
    holes: list[list] = []  # [text pattern, closing quote, hole's opening, braces open in the hole]
    pos, size = 0, len(data)

    def text_of(pattern, quote: bytes, hole: bytes, begin: int, body: int) -> int:
        """From the start of a piece of an interpolated literal: to its end, or into its next hole."""
        stop = pattern.match(data, body).end()
        if data.startswith(hole, stop):
            out.append((begin, stop + len(hole), PART, body, stop))
            holes.append([pattern, quote, hole, 0])
            return stop + len(hole)
        stop = stop + len(quote) if data.startswith(quote, stop) else stop
        out.append((begin, stop, PART, body, stop))
        return stop

    while m := (inside if holes else start).search(data, pos):
        i = m.start()
        c = data[i : i + 1]
        pos = i + 1
        if c == b"{":
            holes[-1][3] += 1
        elif c == b"}":
            if holes[-1][3]:
                holes[-1][3] -= 1
            else:
                pattern, quote, hole, _ = holes.pop()
                pos = text_of(pattern, quote, hole, i, i + 1)
        elif c == b"#" or c == b"/" and data[i + 1 : i + 2] == b"/":
            stop = data.find(b"\n", i)
            while lang in ("c", "cpp") and stop > 0 and data[stop - 1 : stop] == b"\\":
                stop = data.find(b"\n", stop + 1)
            pos = stop if stop >= 0 else size
            out.append((i, pos, COMMENT, i, pos))
        elif c == b"/":
            if data[i + 1 : i + 2] == b"*":
                depth, pos = 1, i + 2
                while depth and (n := _NESTED.search(data, pos)):
                    depth += -1 if n[0] == b"*/" else lang == "rust"
                    pos = n.end()
                pos = size if depth else pos
                out.append((i, pos, COMMENT, i, pos))
            elif lang in ("javascript", "typescript") and not _before_is_value(data, i, out) and (n := _REGEX.match(data, i)):
                pos = n.end()
                out.append((i, pos, PART, i, pos))
        elif c == b"`":
            if lang == "go":
                stop = data.find(b"`", pos)
                if stop >= 0:
                    out.append((i, stop + 1, STRING, i + 1, stop))
                    pos = stop + 1
            else:
                stop = _TEMPLATE.match(data, pos).end()
                if data[stop : stop + 1] == b"`":
                    out.append((i, stop + 1, STRING, i + 1, stop))
                    pos = stop + 1
                else:
                    pos = text_of(_TEMPLATE, b"`", b"${", i, pos)
        else:
            before = _PREFIX.search(data, max(0, i - 40), i) if i and data[i - 1] in _PREFIXING else None
            prefix = before[0] if before else b""
            begin = i - len(prefix)
            found = _quoted(data, i, c, prefix, lang)
            if found is None:
                continue
            pattern, quote, hole = found
            body = i + len(quote)
            if hole:
                pos = text_of(pattern, quote, hole, begin, body)
            elif n := pattern.match(data, body):
                pos, stop = n.end(), n.end() - len(quote)
                if pattern is _RAW_CPP:
                    body, stop = body + len(n[1]) + 1, stop - len(n[1]) - 1
                if not (prefix.strip(b"rRbBuUfFlL8@$c#") == b""):
                    begin = i
                hashes = prefix.count(b"#")
                if hashes:
                    stop -= hashes
                out.append((begin, pos, STRING, body, stop))
    return out


_HASHED: dict[int, re.Pattern] = {}


def _quoted(data: bytes, i: int, c: bytes, prefix: bytes, lang: str):
    """(pattern from the body on, opening quote, hole's opening or empty) of the literal whose quote is at i; None if the
    quote begins none."""
    if lang == "python":
        kind = prefix.lower()
        quote = c * 3 if data.startswith(c * 3, i) else c
        if kind in (b"f", b"fr", b"rf", b"t", b"rt", b"tr"):
            return _FORMATTED[quote], quote, b"{"
        return (_TRIPLE if len(quote) == 3 else _LINE)[quote], quote, b""
    if c == b"'":
        if lang in ("javascript", "typescript"):
            return _LINE[c], c, b""
        if prefix[:1].isdigit() or data[i - 1 : i].isalnum() and _digit_token(data, i):  # 1'000
            return None
        return (_CHARACTER if lang == "rust" else _LINE[c]), c, b""
    if lang == "rust":
        if b"#" in prefix and b"r" in prefix or prefix in (b"r", b"br", b"cr"):
            n = prefix.count(b"#")
            if n not in _HASHED:
                _HASHED[n] = re.compile(rb'[^"]*(?:"(?!%s)[^"]*)*"%s' % (b"#" * n, b"#" * n), re.S)
            return _HASHED[n], c, b""
        return _MULTI, c, b""
    if lang == "cpp" and prefix in (b"R", b"LR", b"uR", b"UR", b"u8R"):
        return _RAW_CPP, c, b""
    if lang == "csharp":
        if data.startswith(b'"""', i):
            quote = _DOUBLED.match(data, i)[0]
            return re.compile(rb".*?" + quote, re.S), quote, b""
        if b"$" in prefix:
            return (_INTERPOLATED_VERBATIM if b"@" in prefix else _INTERPOLATED), c, b"{"
        if b"@" in prefix:
            return _VERBATIM, c, b""
    if lang == "java" and data.startswith(b'"""', i):
        return _TRIPLE[b'"""'], b'"""', b""
    return _LINE[c], c, b""


def _digit_token(data: bytes, i: int) -> bool:
    k = i
    while k and (data[k - 1 : k].isalnum() or data[k - 1] in b"'._"):
        k -= 1
    return data[k : k + 1].isdigit()
