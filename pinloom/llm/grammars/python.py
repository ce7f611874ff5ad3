"""Python 3.13, after its published grammar. The lexer makes NEWLINE, INDENT and DEDENT, and opens f-strings."""

from __future__ import annotations

import re
import unicodedata

from pinloom.llm.peg import Grammar, Tokens

#: The reserved words.
KEYWORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global if import in is
    lambda nonlocal not or pass raise return try while with yield""".split()
)

_BLANK, _LINE = re.compile(r"[ \t\f]*"), re.compile(r"[^\r\n]*")
_TOKEN = re.compile(
    r"""[ \t\f]*+(?:(?P<NAME>[^\W\d]\w*)
    |(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
      |(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)
    |(?P<quote>"{3}|'{3}|"|')
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|>>|<<|[+\-*/%@&|^~<>()\[\]{},:.;=!])
    |(?P<cont>\\\r?\n|\\\r)|(?P<NL>\r\n|\r|\n)|(?P<comment>\#[^\r\n]*))""",
    re.X,
)
_WORD = re.compile(r"\w+")
_PREFIX = re.compile(r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])\Z")
_BODY = {q: re.compile(rf"(?:[^\\{q[0]}]|\\.)*+{q}" if len(q) == 3 else rf"(?:[^\\{q}\r\n]|\\(?:\r\n|.))*+{q}", re.S) for q in ("'", '"')}
_BODY |= {q: re.compile(rf"(?:[^\\{q[0]}]|\\.|{q[0]}{{1,2}}(?!{q[0]}))*+{q}", re.S) for q in ("'''", '"""')}
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_ZEROS = re.compile(r"0[0_]*[1-9][0-9_]*\Z")
_BAD_X = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_BAD_U = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
MAX_DEPTH, MAX_INDENT = 200, 100


class LexError(Exception):
    """The lexer can't go on at a place."""

    def __init__(self, place: int, why: str) -> None:
        self.place, self.why = place, why


def bad_escape(body: str, binary: bool) -> bool:
    """Whether a plain string holds an incomplete escape."""
    if "\\" not in body:
        return False
    if _BAD_X.search(body) or (not binary and _BAD_U.search(body)):
        return True
    if not binary:
        for m in re.finditer(r"(?<!\\)(?:\\\\)*\\N\{([^}]+)\}", body):
            try:
                unicodedata.lookup(m.group(1))
            except KeyError:
                return True
    return False


class Lexer:
    def __init__(self, text: str) -> None:
        self.s, self.n, self.out = text, len(text), Tokens()

    def add(self, kind: str, text: str, offset: int) -> None:
        out = self.out
        out.kinds.append(kind), out.texts.append(text), out.offsets.append(offset)

    def run(self) -> Tokens:
        try:
            self.top()
        except LexError as e:
            self.add("BAD", self.s[e.place : e.place + 1], e.place)
            self.out.problem = e.why
        self.add("$", "", self.n)
        self.out.newline = self.out.joined = [False] * len(self.out.kinds)
        return self.out

    def top(self) -> None:
        s, n, out = self.s, self.n, self.out
        indents, alternatives = [0], [0]
        stack: list[str] = []
        pos, fresh = 0, True
        match, kinds, texts, offsets = _TOKEN.match, out.kinds, out.texts, out.offsets
        while pos < n:
            if fresh and not stack:
                m = _BLANK.match(s, pos)
                at = m.end()
                if at >= n:
                    break
                if s[at] in "#\r\n":
                    comment = _LINE.match(s, at).end() if s[at] == "#" else at
                    if comment > at:
                        out.comments.append((at, comment))
                    pos = comment + (2 if s.startswith("\r\n", comment) else 1)
                    continue
                if s[at] == "\\" and (m2 := _TOKEN.match(s, at)) and m2.lastgroup == "cont":
                    pos = m2.end()
                    if pos >= n:
                        raise LexError(n, "continuation")
                    continue
                blank = m.group()
                # spaces alone count one each
                column = other = 0 if "\t" in blank or "\f" in blank else len(blank)
                for c in blank if not column else "":
                    if c == " ":
                        column, other = column + 1, other + 1
                    elif c == "\t":
                        column, other = column // 8 * 8 + 8, other + 1
                    else:
                        column = other = 0
                if column == indents[-1]:
                    if other != alternatives[-1]:
                        raise LexError(at, "indentation")
                elif column > indents[-1]:
                    if other <= alternatives[-1] or len(indents) >= MAX_INDENT:
                        raise LexError(at, "indentation")
                    indents.append(column)
                    alternatives.append(other)
                    self.add("INDENT", "", at)
                else:
                    while column < indents[-1]:
                        indents.pop()
                        alternatives.pop()
                        self.add("DEDENT", "", at)
                    if column != indents[-1] or other != alternatives[-1]:
                        raise LexError(at, "indentation")
                pos = at
            fresh = False
            m = match(s, pos)
            kind = m.lastgroup if m else ""
            if kind == "op":
                word, pos = m.group(kind), m.end()
                if word in _OPEN:
                    if len(stack) >= MAX_DEPTH:
                        raise LexError(m.start(kind), "nesting")
                    stack.append(_OPEN[word])
                elif word in _CLOSE and (not stack or stack.pop() != word):
                    raise LexError(m.start(kind), "bracket")
                kinds.append(word), texts.append(word), offsets.append(m.start(kind))
                continue
            if kind == "NAME":
                word, end = m.group(kind), m.end()
                follow = s[end : end + 1]
                if word.isascii() and follow not in ("'", '"') and follow <= "\x7f":
                    kinds.append(word if word in KEYWORDS else "NAME"), texts.append(word), offsets.append(m.start(kind))
                    pos = end
                    continue
            if not m and _BLANK.match(s, pos).end() >= n:
                break
            kind, pos = self.one(pos, stack)
            if kind == "cont" and pos >= n:
                raise LexError(n, "continuation")
            if kind == "NL" and not stack:
                self.add("NEWLINE", "", pos)
                fresh = True
        if stack:
            raise LexError(n, "bracket")
        if out.kinds and out.kinds[-1] not in ("NEWLINE", "DEDENT"):
            self.add("NEWLINE", "", n)
        for _ in indents[1:]:
            self.add("DEDENT", "", n)

    def one(self, pos: int, stack: list[str]) -> tuple[str, int]:
        """Adds the token at ``pos``; returns its group and the place after it."""
        s, out = self.s, self.out
        m = _TOKEN.match(s, pos)
        if not m:
            raise LexError(_BLANK.match(s, pos).end(), "character")
        kind = m.lastgroup
        word, pos, end = m.group(kind), m.start(kind), m.end()
        if kind == "NAME":
            quote = s[end : end + 1]
            if quote and quote in "'\"" and len(word) <= 2 and _PREFIX.match(word):
                return "STR", self.string(pos, end, word.lower())
            # marks that go on an identifier are no word characters to a pattern
            while s[end : end + 1] > "\x7f" and (word + s[end]).isidentifier():
                word, end = word + s[end], end + 1
                if more := _WORD.match(s, end):
                    word, end = word + more.group(), more.end()
            if not word.isascii() and not word.isidentifier():
                word = unicodedata.normalize("NFKC", word)
                if not word.isidentifier():
                    raise LexError(pos, "character")
            self.add(word if word in KEYWORDS else "NAME", word, pos)
        elif kind == "op":
            if word in _OPEN:
                if len(stack) >= MAX_DEPTH:
                    raise LexError(pos, "nesting")
                stack.append(_OPEN[word])
            elif word in _CLOSE:
                if not stack or stack.pop() != word:
                    raise LexError(pos, "bracket")
            self.add(word, word, pos)
        elif kind == "quote":
            return "STR", self.string(pos, pos, "")
        elif kind == "NUM":
            follow = s[end : end + 1]
            if follow and (follow.isalnum() or follow == "_") and not _AFTER_NUMBER.match(s, end):
                raise LexError(pos, "number")
            if _ZEROS.match(word):
                raise LexError(pos, "number")
            self.add("NUM", word, pos)
        elif kind == "comment":
            out.comments.append((pos, end))
        return kind, end

    def string(self, pos: int, at: int, prefix: str) -> int:
        s = self.s
        quote = s[at : at + 3] if s[at : at + 3] in ("'''", '"""') else s[at]
        if "f" in prefix:
            self.add("FSTART", s[pos : at + len(quote)], pos)
            end = self.formatted(at + len(quote), quote, "r" in prefix, 0)
            self.add("FEND", quote, end)
            return end + len(quote)
        m = _BODY[quote].match(s, at + len(quote))
        if not m:
            raise LexError(pos, "string")
        body = m.group()[: -len(quote)]
        binary = "b" in prefix
        if (binary and not body.isascii()) or ("r" not in prefix and bad_escape(body, binary)):
            raise LexError(pos, "string")
        self.add("BYTES" if binary else "STR", s[pos : m.end()], pos)
        return m.end()

    def formatted(self, pos: int, quote: str, raw: bool, depth: int) -> int:
        """The inside of an f-string or of a format specification; returns the place of the quote or brace that ends it."""
        s, n, out, start = self.s, self.n, self.out, pos
        if depth > 2:
            raise LexError(pos, "string")
        while True:
            if pos >= n:
                raise LexError(start, "string")
            c = s[pos]
            if s.startswith(quote, pos) and not depth:
                return pos
            if depth and s.startswith(quote, pos):
                raise LexError(pos, "string")
            if c in "\r\n" and (len(quote) == 1):
                raise LexError(pos, "string")
            if c == "\\" and not raw:
                if s.startswith("\\N{", pos):
                    close = s.find("}", pos)
                    if close < 0 or bad_escape(s[pos : close + 1], False):
                        raise LexError(pos, "string")
                    pos = close + 1
                elif s[pos + 1 : pos + 2] in ("{", "}"):
                    pos += 1
                else:
                    if bad_escape(s[pos : pos + 12], False) and s[pos + 1 : pos + 2] in ("x", "u", "U", "N"):
                        raise LexError(pos, "string")
                    pos += 3 if s.startswith("\\\r\n", pos) else 2
            elif c == "\\" and s[pos + 1 : pos + 2] not in ("{", "}", ""):
                pos += 2
            elif c == "{" and s.startswith("{{", pos) and not depth:
                pos += 2
            elif c == "}" and depth:
                return pos
            elif c == "}":
                if not s.startswith("}}", pos):
                    raise LexError(pos, "string")
                pos += 2
            elif c == "{":
                pos = self.replacement(pos, quote, raw, depth)
            else:
                pos += 1

    def replacement(self, pos: int, quote: str, raw: bool, depth: int) -> int:
        s, n, out = self.s, self.n, self.out
        self.add("F{", "{", pos)
        pos += 1
        stack: list[str] = []
        while True:
            while pos < n and (s[pos] in " \t\f" or (s[pos] in "\r\n")):
                pos += 1
            if pos >= n:
                raise LexError(n, "string")
            c = s[pos]
            if not stack:
                if c == "}":
                    self.add("F}", "}", pos)
                    return pos + 1
                if c == "!" and s[pos + 1 : pos + 2] != "=":
                    m = re.compile(r"!([rsa])(?=[ ]*[:}])").match(s, pos)
                    if not m:
                        raise LexError(pos, "string")
                    self.add("F!", m.group(), pos)
                    pos = m.end()
                    continue
                if c == ":":
                    self.add("F:", ":", pos)
                    pos = self.formatted(pos + 1, quote, raw, depth + 1)
                    continue
                if s.startswith(":=", pos):
                    raise LexError(pos, "string")
            _, pos = self.one(pos, stack)


GRAMMAR = Grammar(
    """
file = statement* '$'
statement = compound / simples
simples = simple (';' simple)* ';'? 'NEWLINE'
simple = 'pass' / 'break' / 'continue'
  / 'return' stars? / imports / 'raise' (expr ('from' expr)?)? / 'del' dels &(';' / 'NEWLINE') / 'assert' expr (',' expr)?
  / ('global' / 'nonlocal') list<'NAME'> / "type" 'NAME' tparams? '=' expr &(';' / 'NEWLINE')
  / yields &(';' / 'NEWLINE') / stars &(';' / 'NEWLINE') / assignment
assignment = 'NAME' ':' expr ('=' (yields / stars))? / ('(' single ')' / attribute) ':' expr ('=' (yields / stars))?
  / (targets '=')+ (yields / stars) !'=' / single aug (yields / stars)
aug = '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//='
imports = 'import' list<dotted ('as' 'NAME')?>
  / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' list<'NAME' ('as' 'NAME')?> ','? ')' / list<'NAME' ('as' 'NAME')?> !',')
dotted = 'NAME' ('.' 'NAME')*

single = attribute / 'NAME' / '(' single ')'
attribute! = atom (trailer &('(' / '[' / '.'))* ('.' 'NAME' / '[' slices ']') !('(' / '[' / '.')
targets! = target (',' target)* ','?
target = '*' !'*' target1 / target1
target1! = attribute / 'NAME' / '(' ')' / '(' target1 ')' / '(' targets ')' / '[' targets? ']'
dels = del1 (',' del1)* ','?
del1! = attribute / 'NAME' / '(' dels? ')' / '[' dels? ']'

compound = function / class / 'if' named ':' block elifs? / 'while' named ':' block else? / for / try / with / match / decorated / asyncs
elifs = 'elif' named ':' block elifs? / else
else = 'else' ':' block
for = 'for' targets 'in' stars ':' block else?
asyncs = 'async' (fn / for / with)
with = 'with' (&'(' '(' list<item> ','? ')' ':' block / list<item> ':' block)
item = expr 'as' target &(',' / ')' / ':') / expr
try = 'try' ':' block (finally / excepts+ else? finally? / groups+ else? finally?)
finally = 'finally' ':' block
excepts = 'except' (expr ('as' 'NAME')?)? ':' block
groups = 'except' '*' expr ('as' 'NAME')? ':' block
decorated = ('@' named 'NEWLINE')+ (class / function / 'async' fn)
class = 'class' 'NAME' tparams? ('(' args? ')')? ':' block
function = fn
fn@ = 'def' 'NAME' tparams? '(' params? ')' ('->' expr)? ':' block
block = 'NEWLINE' 'INDENT' statement+ 'DEDENT' / simples

params = slash0 param0* param1* etc? / slash1 param1* etc? / param0+ param1* etc? / param1+ etc? / etc
slash0 = param0+ '/' (',' / &')')
slash1 = param0* param1+ '/' (',' / &')')
param0 = 'NAME' (':' expr)? (',' / &')')
param1 = 'NAME' (':' expr)? '=' expr (',' / &')')
paramx = 'NAME' (':' expr)? ('=' expr)? (',' / &')')
etc = '*' 'NAME' (':' (expr / '*' bits))? (',' / &')') paramx* kwds? / '*' ',' paramx+ kwds? / kwds
kwds = '**' 'NAME' (':' expr)? (',' / &')')
lambda = 'lambda' lparams? ':' expr
lparams = lslash0 lparam0* lparam1* letc? / lslash1 lparam1* letc? / lparam0+ lparam1* letc? / lparam1+ letc? / letc
lslash0 = lparam0+ '/' (',' / &':')
lslash1 = lparam0* lparam1+ '/' (',' / &':')
lparam0 = 'NAME' (',' / &':')
lparam1 = 'NAME' '=' expr (',' / &':')
lparamx = 'NAME' ('=' expr)? (',' / &':')
letc = '*' 'NAME' (',' / &':') lparamx* lkwds? / '*' ',' lparamx+ lkwds? / lkwds
lkwds = '**' 'NAME' (',' / &':')
tparams = '[' list<tparam> ','? ']'
tparam = '*' 'NAME' ('=' (stare))? / '**' 'NAME' ('=' expr)? / 'NAME' (':' expr)? ('=' expr)?

match = "match" subject ':' 'NEWLINE' 'INDENT' case+ 'DEDENT'
subject = snamed ',' (list<snamed> ','?)? / named
case = "case" patterns ('if' named)? ':' block
patterns = mstar ',' (list<mstar> ','?)? / pattern
mstar = '*' 'NAME' / pattern
pattern! = orp ('as' 'NAME')?
orp = closed ('|' closed)*
closed = mnum !('+' / '-') / '-'? 'NUM' ('+' / '-') 'NUM' / strings / 'None' / 'True' / 'False'
  / 'NAME' ('.' 'NAME')* '(' (list<marg> ','?)? ')' / 'NAME' ('.' 'NAME')*
  / '(' (mstar ',' (list<mstar> ','?)?)? ')' / '(' pattern ')' / '[' (list<mstar> ','?)? ']' / '{' (list<mitem> ','?)? '}'
mnum = '-'? 'NUM'
marg = 'NAME' '=' pattern / pattern
mitem = '**' 'NAME' / (mnum !('+' / '-') / '-'? 'NUM' ('+' / '-') 'NUM' / strings / 'None' / 'True' / 'False' / 'NAME' ('.' 'NAME')+) ':' pattern

yields = 'yield' ('from' expr / stars?)
stars! = stare (',' stare)* ','?
stare = '*' bits / expr
snamed = '*' bits / named
named = 'NAME' ':=' expr / expr !':='
expr! = lambda / logic ('if' logic 'else' expr)?
logic = inversion (('and' / 'or') inversion)*
inversion = 'not'* bits (compare bits)*
compare = '==' / '!=' / '<' / '<=' / '>' / '>=' / 'in' / 'not' 'in' / 'is' 'not'?
bits = factor (('+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>') factor)*
factor = ('+' / '-' / '~')* 'await'? primary ('**' factor)?
primary! = atom trailer*
trailer = '.' 'NAME' / '(' (genexp / args?) ')' / '[' slices ']'
genexp = ('NAME' ':=' expr / expr !':=') comp
slices = slice !',' !':' / list<slice / '*' bits> ','?
slice = expr? ':' expr? (':' expr?)? / named
args = arg (',' arg)* (',' kwarg)* (',' dkwarg)* ','? / kwarg (',' kwarg)* (',' dkwarg)* ','? / dkwarg (',' dkwarg)* ','?
arg = '*' expr / ('NAME' ':=' expr / expr !':=') !'='
kwarg = 'NAME' '=' expr / '*' expr
dkwarg = 'NAME' '=' expr / '**' expr
comp = ('async'? 'for' targets 'in' logic ('if' logic)*)+
atom! = 'NAME' / 'NUM' / strings / 'True' / 'False' / 'None' / '...' / paren / bracket / brace
paren = '(' ')' / '(' yields ')' / '(' named comp ')' / '(' named ')' / '(' snamed ',' (list<snamed> ','?)? ')'
bracket = '[' ']' / '[' named comp ']' / '[' list<snamed> ','? ']'
brace = '{' '}' / '{' (pair1 comp / list<pair> ','?) '}' / '{' (named comp / list<snamed> ','?) '}'
pair1 = expr ':' expr
pair = '**' bits / expr ':' expr
strings = 'BYTES'+ / ('STR' / fstring)+
fstring = 'FSTART' field* 'FEND'
field = 'F{' (yields / stars) '='? 'F!'? ('F:' field*)? 'F}'
"""
)


_COOKIE = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")


def decode(data: bytes) -> str | None:
    """The text of a file, by byte order mark or coding line; null if its bytes are none."""
    bom = data.startswith(b"\xef\xbb\xbf")
    data = data[3:] if bom else data
    name = "utf-8"
    lines = data.split(b"\n", 2)[:2]
    for k, line in enumerate(lines):
        if k and lines[0].strip() and not lines[0].lstrip().startswith(b"#"):
            break
        if m := _COOKIE.match(line):
            name = m[1].decode("ascii", "replace")
            # beside the mark only this spelling is accepted, whatever else means the same
            if bom and not re.match(r"utf-8(-|\Z)", name.lower().replace("_", "-")):
                return None
            break
    try:
        text = data.decode(name)
    except (LookupError, UnicodeDecodeError, ValueError):
        return None
    return None if "\0" in text else text


def lex(text: str) -> Tokens:
    return Lexer(text).run()
