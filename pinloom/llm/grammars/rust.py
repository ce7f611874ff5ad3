"""Rust 2021. A greater sign is always a token of its own, so that it can close generics; operators join them again."""

from __future__ import annotations

import re

from pinloom.llm.peg import Grammar, Tokens

#: The reserved words.
KEYWORDS = frozenset(
    """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self
    Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual
    yield try _""".split()
)
_TOKEN = re.compile(
    rf"""[\s‎‏]*+(?:(?P<comment>//[^\n]*)|(?P<block>/\*)
    |(?P<RAW>(?:b|c)?r(?P<hash>\#*)"[\s\S]*?"(?P=hash))|(?P<STR>[bc]?"(?:[^"\\]|\\(?:[nrt0\\'"]|x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]{{1,8}}\}}|\r?\n))*+")
    |(?P<CHAR>b?'(?:[^'\\\n\r\t]|\\(?:[nrt0\\'"]|x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]{{1,8}}\}}))')|(?P<LIFE>'[^\W\d]\w*)
    |(?P<NAME>(?:r\#)?[^\W\d]\w*)
    |(?P<NUM>(?:0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7_]*[0-7][0-7_]*|0b[01_]*[01][01_]*|[0-9][0-9_]*(?:\.(?![._]|[^\W\d])(?:[0-9][0-9_]*)?)?(?:[eE][+-]?_*[0-9][0-9_]*)?)(?:[^\W\d]\w*)?)
    |(?P<op>\.\.=|\.\.\.|<<=|\.\.|::|->|=>|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|[+\-*/%^!&|=<>@.,;:\#$?~(){{}}\[\]]))""",
    re.X,
)
_BLANK = re.compile(r"[\s‎‏]*")
_PLAIN_NUM = re.compile(r"(?:0x[0-9a-fA-F_]+?|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*(?:\.(?:[0-9][0-9_]*)?)?(?:[eE][+-]?_*[0-9][0-9_]*)?)(?:u8|u16|u32|u64|u128|usize|i8|i16|i32|i64|i128|isize|f32|f64)?\Z")
_COMMENT = re.compile(r"/\*|\*/")


def lex(text: str) -> Tokens:
    out, pos, n = Tokens(), 0, len(text)
    spaced = True
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        pos = text.find("\n") if "\n" in text else n

    def bad(why: str) -> None:
        out.kinds.append("BAD"), out.texts.append(text[pos : pos + 1]), out.offsets.append(pos), out.joined.append(False)
        out.problem = why

    match, kinds, texts, offsets, joined = _TOKEN.match, out.kinds, out.texts, out.offsets, out.joined
    while pos < n:
        m = match(text, pos)
        if not m:
            pos = _BLANK.match(text, pos).end()
            if pos < n:
                bad("string" if text[pos] in "\"'" else "character")
            break
        kind = m.lastgroup
        word, start, end = m.group(kind), m.start(kind), m.end()
        if start > pos:
            spaced, pos = True, start
        if kind == "comment":
            out.comments.append((pos, end))
            spaced, pos = True, end
            continue
        if kind == "block":
            depth = 1
            while depth and (m2 := _COMMENT.search(text, end)):
                depth += 1 if m2.group() == "/*" else -1
                end = m2.end()
            if depth:
                bad("comment")
                break
            out.comments.append((pos, end))
            spaced, pos = True, end
            continue
        token = kind
        if kind == "NAME":
            token = word if word in KEYWORDS else "NAME"
            if text[end : end + 1] in ("'", '"') and (text[end] == '"' or not re.match(r"'[^\W\d]\w*(?!')", text[end:])):
                bad("string")
                break
        elif kind == "op":
            token = "DOLLAR" if word == "$" else word
        elif kind == "NUM" and not _PLAIN_NUM.match(word):
            bad("number")
            break
        elif kind in ("RAW", "hash"):
            token = "STR"
        kinds.append(token), texts.append(word), offsets.append(pos), joined.append(not spaced)
        spaced = False
        pos = end
    kinds.append("$"), texts.append(""), offsets.append(n), joined.append(False)
    out.newline = [False] * len(kinds)
    return out


_EXPRESSIONS = """
exprS! = rangeS (aop exprS)?
rangeS = ('..=' / '..') (NOBRACE rangeS)? / binaryS (('..=' / '..') (NOBRACE binaryS)?)?
binaryS = castS (bop castS)*
castS = unaryS ('as' typenb)*
unaryS = ('-' / '!' / '*') unaryS / ('&' / '&&') ("raw" ('const' / 'mut') / 'mut')? unaryS / closureS / postfixS
closureS = ('for' '<' list<'LIFE'>? '>')? 'static'? 'async'? 'move'? ('||' / '|' (list<attrs pattern1 (':' type)?> ','?)? '|') ('->' typenb block / exprS)
postfixS! = primaryS suffix*
primaryS = 'return' (NOBRACE exprS)? / 'break' 'LIFE'? (NOBRACE exprS)? / 'continue' 'LIFE'? / blocklike / literal / pathexpr ('!' delimited STRUCT)? / '(' attrs ')' / '(' inner* list<expr> ','? ')' / '[' inner* (expr ';' expr / list<expr> ','?)? ']'
"""

GRAMMAR = Grammar(
    """
crate = inner* item* '$'
inner = '#' '!' '[' tt* ']'
attrs = ('#' '[' tt* ']')*
tt = '(' tt* ')' / '[' tt* ']' / '{' tt* '}' / 'any'
delimited = '(' tt* ')' / '[' tt* ']' / '{' tt* '}'
vis = 'pub' ('(' ('crate' / 'self' / 'super' / 'in' simplepath) ')')?
item = attrs (vis? (function / struct / enum / union / const / static / typealias / mod / use / trait / impl / externcrate / externblock) / macroitem)
macroitem = "macro_rules" '!' 'NAME' ('{' tt* '}' / ('(' tt* ')' / '[' tt* ']') ';') / simplepath '!' ('{' tt* '}' / ('(' tt* ')' / '[' tt* ']') ';')
simplepath = '::'? seg ('::' seg)*
seg = 'NAME' / 'self' / 'super' / 'crate' / 'Self'
function = 'const'? 'async'? ('unsafe')? ('extern' 'STR'?)? 'fn' fname generics? '(' fparams? ')' ('->' type)? where? (body / ';')
fname@ = 'NAME'
fparams = list<fparam> ','?
fparam = attrs ('&' 'LIFE'? 'mut'? 'self' &(',' / ')') / 'mut'? 'self' (':' type)? &(',' / ')') / '...' / pattern1 ':' ('...' / type) / type)
struct = 'struct' 'NAME' generics? (where? fields / '(' tuplefields? ')' where? ';' / where? ';')
fields = '{' (list<attrs vis? 'NAME' ':' type> ','?)? '}'
tuplefields = list<attrs vis? type> ','?
enum = 'enum' 'NAME' generics? where? '{' (list<variant> ','?)? '}'
variant = attrs vis? 'NAME' (fields / '(' tuplefields? ')')? ('=' expr)?
union = "union" 'NAME' generics? where? fields
const = 'const' ('NAME' / '_') ':' type ('=' expr)? ';'
static = 'static' 'mut'? 'NAME' ':' type ('=' expr)? ';'
type = fntype / 'impl' bounds / 'dyn' bounds / typebound
typealias = 'type' 'NAME' generics? (':' bounds?)? where? ('=' type)? where? ';'
mod = 'unsafe'? 'mod' 'NAME' (';' / '{' inner* item* '}')
use = 'use' usetree ';'
usetree = '::'? ('*' / '{' (list<usetree> ','?)? '}') / simplepath ('::' ('*' / '{' (list<usetree> ','?)? '}') / 'as' ('NAME' / '_'))?
trait = 'unsafe'? "auto"? 'trait' 'NAME' generics? (':' bounds?)? where? ('{' inner* associated* '}' / '=' bounds where? ';')
impl = 'unsafe'? 'impl' generics? 'const'? ('!'? typenb 'for' type / type) where? '{' inner* associated* '}'
associated = attrs (vis? (function / const / typealias / "default" (function / const / typealias)) / macroitem)
externcrate = 'extern' 'crate' ('NAME' / 'self') ('as' ('NAME' / '_'))? ';'
externblock = 'unsafe'? 'extern' 'STR'? '{' inner* (attrs (vis? (static / function / typealias) / macroitem))* '}'
generics = '<' (list<gparam> ','?)? '>'
gparam = attrs ('LIFE' (':' ('LIFE' ('+' 'LIFE')*)? '+'?)? / 'const' 'NAME' ':' type ('=' (block / '-'? literal / 'NAME'))? / 'NAME' (':' bounds?)? ('=' type)?)
where = 'where' (list<wclause> ','?)?
wclause = 'LIFE' ':' ('LIFE' ('+' 'LIFE')*)? / ('for' generics)? type ':' bounds?
bounds = bound ('+' bound)* '+'?
bound = 'LIFE' / '?'? ('for' generics)? typepath / '(' '?'? ('for' generics)? typepath ')' / '~' 'const' typepath

typebound! = ('for' generics)? typepath ('!' delimited)? ('+' bounds)? / typenb
typenb! = 'impl' bound / 'dyn' bound / fntype / '(' (type ',' list<type>? ','? / type)? ')' / '!' / '*' ('const' / 'mut') typenb / ('&' / '&&') 'LIFE'? 'mut'? typenb
  / '[' type (';' expr)? ']' / '_' / typepath ('!' delimited)? / 'LIFE'
fntype = ('for' generics)? 'unsafe'? ('extern' 'STR'?)? 'fn' '(' (list<attrs (('NAME' / '_') ':')? ('...' / type)> ','?)? ')' ('->' typenb)?
typepath! = qualified ('::' tseg)+ / '::'? tseg ('::' tseg)*
tseg = seg ('::'? (gargs / '(' (list<type> ','?)? ')' ('->' typenb)?))?
qualified = '<' type ('as' typepath)? '>'
gargs = '<' (list<garg> ','?)? '>'
garg = 'LIFE' &(',' / '>') / 'NAME' gargs? ('=' type / ':' bounds) / type &(',' / '>') / '-'? literal / block
literal = 'NUM' / 'STR' / 'CHAR' / 'true' / 'false'
pathexpr! = qualified ('::' eseg)+ / '::'? eseg ('::' eseg)*
eseg = seg ('::' gargs)?

pattern = '|'? pattern1 ('|' pattern1)*
pattern1! = ('-'? literal / pathpat) ('..=' / '...' / '..') (('-'? literal / pathpat))? / ('..=' / '..') ('-'? literal / pathpat) / '..' / '-'? literal / '_'
  / 'ref'? 'mut'? 'NAME' !('::' / '(' / '{' / '!') ('@' pattern1)? / ('&' / '&&') 'mut'? pattern1 / '(' (list<pattern> ','?)? ')' / '[' (list<pattern> ','?)? ']'
  / pathpat ('(' (list<pattern> ','?)? ')' / '{' (list<fieldpat> ','?)? '}' / '!' delimited)? / 'const' block
pathpat = pathexpr
fieldpat = attrs ('..' / ('NAME' / 'NUM') ':' pattern / 'ref'? 'mut'? 'NAME')

body = block
block = '{' inner* stmt* '}'
stmt = ';' / attrs let / attrs blocklike !('.' / '?') ';'? / attrs macrostmt / item / attrs expr (';' / &'}')
macrostmt = simplepath '!' '{' tt* '}' !('.' / '?') ';'?
let = 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blocklike! = label? ('loop' block / 'while' cond block / 'for' pattern 'in' expr0 block / block) / 'if' cond block ('else' (if / block))? / match / 'unsafe' block / 'async' 'move'? block / 'const' block / 'try' block
if = 'if' cond block ('else' (if / block))?
label = 'LIFE' ':'
cond = condpart ('&&' condpart)*
condpart = 'let' pattern '=' letexpr0 / expr0
letexpr0 = cast0 (bopnoand cast0)*
bopnoand = !('&&' / '||') bop
match = 'match' expr0 '{' inner* arm* '}'
arm = attrs pattern ('if' cond)? '=>' (blocklike !('.' / '?' / ',' / '}') !bop / expr (',' / &'}'))
aop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|=' / '<<=' / '>' #joined '>' #joined '='
bop = '||' / '&&' / '==' / '!=' / '<=' / '<<' / '<' / '>' (#joined '>' !(#joined '=') / #joined '=')? / '|' / '^' / '&' / '+' / '-' / '*' / '/' / '%'
suffix = '?' / '.' ('await' / 'NUM' / 'NAME' ('::' gargs)? ('(' callargs ')')?) / '(' callargs ')' / '[' expr ']'
callargs = (list<attrs expr> ','?)?
structlit = '{' (list<fieldinit> ','?)? '}'
fieldinit = attrs ('..' expr? / ('NAME' / 'NUM') ':' expr / 'NAME')
"""
    + _EXPRESSIONS.replace("pathexpr ('!' delimited STRUCT)?", "pathexpr ('!' delimited)?").replace("NOBRACE", "!'{'").replace("S", "0")
    + _EXPRESSIONS.replace("pathexpr ('!' delimited STRUCT)?", "pathexpr ('!' delimited / structlit)?").replace("NOBRACE", "").replace("S", "")
)
