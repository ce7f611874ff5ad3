"""RFC 8259 and TOML 1.0."""

from __future__ import annotations

import re

from pinloom.llm.peg import Grammar, Tokens

_JSON = re.compile(
    r"""(?P<space>[ \t\n\r]+)|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"""
    r"""|(?P<word>[A-Za-z_]+)|(?P<op>[\[\]{}:,])"""
)

JSON = Grammar(
    """
text = value '$'
value = 'STR' / 'NUM' / object / array / 'true' / 'false' / 'null'
object = '{' (member (',' member)*)? '}'
member = 'STR' ':' value
array = '[' (value (',' value)*)? ']'
"""
)


def lex_json(text: str) -> Tokens:
    out, pos, n = Tokens(), 0, len(text)
    while pos < n:
        m = _JSON.match(text, pos)
        if not m or (m.lastgroup == "word" and m.group() not in ("true", "false", "null")) or (m.lastgroup == "NUM" and re.match(r"[0-9A-Za-z_.]", text[m.end() : m.end() + 1])):
            out.add("BAD", text[pos : pos + 1], pos)
            out.problem = "character"
            break
        if m.lastgroup != "space":
            out.add(m.lastgroup if m.lastgroup in ("STR", "NUM") else m.group(), m.group(), pos)
        pos = m.end()
    out.add("$", "", n)
    return out


_ESCAPED = r'\\(?:[btnfr"\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})'
_PLAIN = r"\x00-\x08\x0a-\x1f\x7f"
_TOML = re.compile(
    r"(?P<space>[ \t]+)|(?P<NL>(?:\r?\n))|(?P<comment>#[^\x00-\x08\x0a-\x1f\x7f]*)"
    rf'|(?P<MSTR>"""(?:[^"\\\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]|{_ESCAPED}|\\[ \t]*\r?\n[ \t\r\n]*|"{{1,2}}(?!"))*+"{{3,5}})'
    r"|(?P<MLIT>'''(?:[^'\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*+'{3,5})"
    rf'|(?P<STR>"(?:[^"\\{_PLAIN}]|{_ESCAPED})*+")|(?P<LIT>\'[^\'{_PLAIN}]*\')'
    r"|(?P<bare>[A-Za-z0-9_+\-][A-Za-z0-9_+\-.:]*)|(?P<op>[\[\]{}=.,])"
)
_INT = r"(?:[+-]?(?:0|[1-9](?:_?[0-9])*)|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*)"
_FLOAT = r"(?:[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[eE][+-]?[0-9](?:_?[0-9])*)|[+-]?(?:inf|nan))"
_DATE, _TIME = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?"
_SCALAR = re.compile(rf"(?:true|false|{_INT}|{_FLOAT}|{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?|{_TIME})\Z")
_SPACED = re.compile(rf"{_DATE} {_TIME}(?:[Zz]|[+-][0-9]{{2}}:[0-9]{{2}})?")
_BARE_KEY = re.compile(r"[A-Za-z0-9_-]+\Z")

TOML = Grammar(
    """
text = line ('NL' line)* '$'
line = (header / pair)?
header = '[[' key ']]' / '[' key ']'
pair = key '=' value
key = part ('.' part)*
part = 'KEY' / 'STR' / 'LIT'
value = 'STR' / 'LIT' / 'MSTR' / 'MLIT' / 'SCALAR' / array / table
array = '[' 'NL'* (value 'NL'* (',' 'NL'* value 'NL'*)* (',' 'NL'*)?)? ']'
table = '{' (pair (',' pair)*)? '}'
"""
)


def lex_toml(text: str) -> Tokens:
    """Whether a word is a key or a value depends on what stands before it, so the lexer keeps the open brackets."""
    out, pos, n = Tokens(), 0, len(text)
    stack: list[str] = []
    value = False  # after an equals sign or within an array
    header = False  # within the header of an array of tables
    while pos < n:
        m = _TOML.match(text, pos)
        kind = m.lastgroup if m else "BAD"
        if kind in ("space", "comment"):
            pos = m.end()
            continue
        if kind == "BAD" or kind == "comment":
            out.add("BAD", text[pos], pos)
            out.problem = "string" if text[pos] in "\"'" else "character"
            break
        word = m.group()
        end = m.end()
        if kind == "NL":
            if not stack:
                value = False
            header = False
            out.add("NL", word, pos)
        elif kind == "bare":
            if value:
                if spaced := _SPACED.match(text, pos):
                    word, end = spaced.group(), max(end, spaced.end())
                out.add("SCALAR" if _SCALAR.match(word) else "BAD", word, pos)
            else:
                parts = re.split(r"(\.)", word)
                at = pos
                for part in parts:
                    if part:
                        out.add("." if part == "." else "KEY" if _BARE_KEY.match(part) else "BAD", part, at)
                    at += len(part)
        elif kind == "op":
            if word == "=":
                value = True
            elif word == "[":
                if not value and not stack and text.startswith("[[", pos):
                    word, end = "[[", pos + 2
                    header = True
                elif value:
                    stack.append("[")
            elif word == "]":
                if stack and stack[-1] == "[":
                    stack.pop()
                elif not stack and header and text.startswith("]]", pos):
                    word, end = "]]", pos + 2
                    header = False
            elif word == "{":
                stack.append("{")
                value = False
            elif word == "}" and stack and stack[-1] == "{":
                stack.pop()
                value = True
            elif word == "," and stack:
                value = stack[-1] == "["
            out.add(word, word, pos)
        else:
            out.add(kind, word, pos)
        pos = end
    out.add("$", "", n)
    return out


class _Table:
    """What a TOML text has defined at a place: sub-tables by key, null for plain values."""

    __slots__ = ("items", "header", "dotted", "closed", "array")

    def __init__(self) -> None:
        self.items: dict[str, _Table | None] = {}
        self.header = False  # named by a header of its own
        self.dotted = False  # made by a dotted key
        self.closed = False  # an inline table or a value
        self.array = False  # an array of tables; ``items`` belong to its last one


def _key_text(kind: str, word: str) -> str:
    return word if kind == "KEY" else word[1:-1] if kind == "LIT" else _unescaped(word[1:-1])


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
_PLAIN = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: _PLAIN.get(m[3], m[0]) if m[3] else chr(int(m[1] or m[2], 16)), text)


def toml_conflict(tokens: Tokens) -> int:
    """The first token that defines a key or table for the second time, which TOML forbids beside its grammar, or that is no date; -1 if
    there is none. Run over tokens that the grammar accepts."""
    kinds, texts = tokens.kinds, tokens.texts
    root = _Table()
    now = root
    i, n = 0, len(kinds)

    def key(i: int) -> tuple[list[str], int]:
        parts = []
        while kinds[i] in ("KEY", "STR", "LIT"):
            parts.append(_key_text(kinds[i], texts[i]))
            i += 1
            if kinds[i] != ".":
                break
            i += 1
        return parts, i

    def assign(table: _Table, parts: list[str]) -> tuple[_Table, str] | None:
        """The table that a dotted key ends in, and its last part; null if the way there is closed or the key is taken."""
        for p in parts[:-1]:
            inner = table.items.setdefault(p, _Table())
            # tables that have a header of their own, or are arrays, can't be added to by dotted keys
            if inner is None or inner.closed or inner.array or inner.header:
                return None
            inner.dotted = True
            table = inner
        return None if parts[-1] in table.items else (table, parts[-1])

    def value(i: int) -> tuple[_Table | None, int, int]:
        """(table of an inline table, place after the value, first bad token or -1)"""
        if kinds[i] == "[":
            i += 1
            while kinds[i] != "]":
                if kinds[i] in ("NL", ","):
                    i += 1
                    continue
                _, i, bad = value(i)
                if bad >= 0:
                    return None, i, bad
            return None, i + 1, -1
        if kinds[i] == "{":
            table = _Table()
            i += 1
            while kinds[i] != "}":
                if kinds[i] == ",":
                    i += 1
                    continue
                at = i
                parts, i = key(i)
                place = assign(table, parts)
                if place is None:
                    return None, i, at
                inner, i, bad = value(i + 1)
                if bad >= 0:
                    return None, i, bad
                place[0].items[place[1]] = inner
            _close(table)
            return table, i + 1, -1
        return None, i + 1, i if kinds[i] == "SCALAR" and not _real_time(texts[i]) else -1

    while i < n:
        kind = kinds[i]
        if kind in ("[", "[["):
            at = i
            parts, i = key(i + 1)
            table = root
            for p in parts[:-1]:
                inner = table.items.setdefault(p, _Table())
                if inner is None or inner.closed:
                    return at
                table = inner
            last = parts[-1]
            inner = table.items.get(last)
            if kind == "[[":
                if last not in table.items:
                    table.items[last] = inner = _Table()
                    inner.array = True
                elif inner is None or not inner.array:
                    return at
                inner.items = {}
            else:
                if last not in table.items:
                    table.items[last] = inner = _Table()
                elif inner is None or inner.header or inner.dotted or inner.array or inner.closed:
                    return at
                inner.header = True
            now = inner
            i += 1
        elif kind in ("KEY", "STR", "LIT"):
            at = i
            parts, i = key(i)
            place = assign(now, parts)
            if place is None:
                return at
            inner, i, bad = value(i + 1)
            if bad >= 0:
                return bad
            place[0].items[place[1]] = inner
        else:
            i += 1
    return -1


def _close(table: _Table) -> None:
    stack = [table]
    while stack:
        t = stack.pop()
        t.closed = True
        stack += [x for x in t.items.values() if x is not None]


_DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)")
_CLOCK = re.compile(r"(?:^|[Tt ])(\d\d):(\d\d):(\d\d)")
_OFFSET = re.compile(r"[+-](\d\d):(\d\d)$")


def _real_time(word: str) -> bool:
    """Whether the dates and times in a scalar exist."""
    if m := _DATE.match(word):
        year, month, day = map(int, m.groups())
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        if not year or not 1 <= month <= 12 or not 1 <= day <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]:
            return False
    if m := _CLOCK.search(word):
        hour, minute, second = map(int, m.groups())
        if hour > 23 or minute > 59 or second > 59:
            return False
        if (z := _OFFSET.search(word, m.end())) and (int(z[1]) > 23 or int(z[2]) > 59):
            return False
    return True
