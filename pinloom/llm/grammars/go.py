"""Go 1.22. The lexer inserts semicolons at line ends, as the language prescribes."""

from __future__ import annotations

import re

from pinloom.llm.peg import Grammar, Tokens

#: The reserved words.
KEYWORDS = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select
    struct switch type var""".split()
)
_ESC = r"\\(?:[abfnrtv\\{q}]|x[0-9a-fA-F]{{2}}|[0-7]{{3}}|u[0-9a-fA-F]{{4}}|U00(?:10|0[0-9a-fA-F])[0-9a-fA-F]{{4}})"
_TOKEN = re.compile(
    rf"""[ \t\r]*+(?:(?P<NL>\n)|(?P<comment>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<NAME>[^\W\d]\w*)
    |(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])*\.?(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?(?:[pP][+-]?[0-9](?:_?[0-9])*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
      |[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?)i?)
    |(?P<STR>"(?:[^"\\\n]|{_ESC.format(q='"')})*+"|`[^`]*`)|(?P<CHAR>'(?:[^'\\\n]|{_ESC.format(q="'")})')
    |(?P<op>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{{}},;.:~]))""",
    re.X,
)
_BLANK = re.compile(r"[ \t\r]*")
_ENDS = frozenset(["NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_OCTAL = re.compile(r"0[0-9_]*[89][0-9_]*\Z")


def lex(text: str) -> Tokens:
    out, pos, n = Tokens(), 0, len(text)
    kinds, texts, offsets = out.kinds, out.texts, out.offsets
    match = _TOKEN.match
    while pos < n:
        m = match(text, pos)
        if not m:
            pos = _BLANK.match(text, pos).end()
            if pos < n:
                kinds.append("BAD"), texts.append(text[pos : pos + 1]), offsets.append(pos)
                out.problem = "string" if text[pos] in "\"'`" else "character"
            break
        kind = m.lastgroup
        word, pos, end = m.group(kind), m.start(kind), m.end()
        if kind == "op":
            kinds.append(word), texts.append(word), offsets.append(pos)
        elif kind == "NAME":
            kinds.append(word if word in KEYWORDS else "NAME"), texts.append(word), offsets.append(pos)
        elif kind == "NL" or (kind == "block" and "\n" in word):
            if kinds and kinds[-1] in _ENDS:
                kinds.append(";"), texts.append("\n"), offsets.append(pos)
            if kind == "block":
                out.comments.append((pos, end))
        elif kind in ("comment", "block"):
            out.comments.append((pos, end))
        else:
            follow = text[end : end + 1]
            if kind == "NUM" and ((follow and (follow.isalnum() or follow == "_")) or _OCTAL.match(word)):
                kinds.append("BAD"), texts.append(word), offsets.append(pos)
                out.problem = "number"
                break
            kinds.append(kind), texts.append(word), offsets.append(pos)
        pos = end
    if kinds and kinds[-1] in _ENDS:
        kinds.append(";"), texts.append(""), offsets.append(n)
    kinds.append("$"), texts.append(""), offsets.append(n)
    out.newline = out.joined = [False] * len(kinds)
    return out


#: Expressions, once as they are and once, with the suffix 0, where a brace begins a block instead of a composite literal.
_EXPRESSIONS = """
exprS! = unaryS (bop unaryS)*
unaryS = ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~') unaryS / primaryS
primaryS! = operandS suffixS*
suffixS = '.' ('NAME' / '(' ('type' / type) ')') / '[' index ']' / '(' callargs? ')'
"""

GRAMMAR = Grammar(
    """
file = 'package' 'NAME' ';' (import ';')* (decl ';')* ';'? '$'
import = 'import' ('(' (importspec (';' importspec)* ';'?)? ')' / importspec)
importspec = ('.' / 'NAME')? 'STR'
decl = 'const' group_const / 'var' group_var / 'type' group_type / func
group_const = '(' (constspec (';' constspec)* ';'?)? ')' / constspec
constspec = names (type? '=' exprs)?
group_var = '(' (varspec (';' varspec)* ';'?)? ')' / varspec
varspec = names (type ('=' exprs)? / '=' exprs)
group_type = '(' (typespec (';' typespec)* ';'?)? ')' / typespec
typespec = 'NAME' tparams '='? type / 'NAME' '='? type
names = list<'NAME'>
exprs = list<expr>
func = 'func' (fname tparams? / '(' param ','? ')' fname) signature block?
fname@ = 'NAME' &('(' / '[')
tparams = '[' list<names constraint> ','? ']'
constraint = term ('|' term)*
term = '~'? type
signature = params result?
params = '(' (list<param> ','?)? ')'
param! = names '...'? type &(',' / ')') / '...'? type
result = params / type

type! = 'NAME' ('.' 'NAME')? targs? / '*' type / '[' (']' type / '...' ']' type / expr ']' type) / 'map' '[' type ']' type / '<-' 'chan' type / 'chan' '<-'? type
  / 'func' signature / 'struct' '{' (fielddecl (';' fielddecl)* ';'?)? '}' / 'interface' '{' (elem (';' elem)* ';'?)? '}' / '(' type ')'
targs = '[' list<type> ','? ']'
fielddecl = ('*'? 'NAME' ('.' 'NAME')? targs? &(';' / '}' / 'STR') / '(' '*'? 'NAME' ')' / names type) 'STR'?
elem = 'NAME' signature / constraint

block = '{' stmts '}'
stmts = ';'* (stmt (';'+ stmt)* ';'*)?
stmt = 'const' group_const / 'var' group_var / 'type' group_type / block / if / for / switch / select / 'go' expr / 'defer' expr / 'return' exprs?
  / ('break' / 'continue') 'NAME'? / 'goto' 'NAME' / 'fallthrough' / 'NAME' ':' !'=' (&(';' / '}') / ';' &'}' / stmt)? / simple
simple = names ':=' exprs / list<expr> (aop exprs / '++' / '--' / '<-' expr)?
aop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
simple0 = names ':=' list<expr0> / list<expr0> (aop list<expr0> / '++' / '--' / '<-' expr0)?
if = 'if' (simple0? ';' expr0 / expr0) block ('else' (if / block))?
for = 'for' ((names ':=' / list<expr0> '=')? 'range' expr0 / simple0? ';' expr0? ';' simple0? / expr0)? block
switch = 'switch' ((simple0? ';')? ('NAME' ':=')? primary0 &'{' typeswitch / (simple0? ';')? expr0? '{' (cases stmts)* '}')
typeswitch = '{' (typecases stmts)* '}'
typecases = ('case' list<type> / 'default') ':'
cases = ('case' exprs / 'default') ':'
select = 'select' '{' (('case' simple / 'default') ':' stmts)* '}'

bop = '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
index = expr? ':' expr? (':' expr)? / list<typeorexpr> ','?
callargs = list<typeorexpr> '...'? ','?
typeorexpr! = expr / type
literal = '{' (list<(value ':')? value> ','?)? '}'
value = literal / expr
operand! = 'NUM' / 'STR' / 'CHAR' / 'func' signature block / littype literal / '(' expr ')' / conversion / 'NAME' / '(' type ')'
operand0! = 'NUM' / 'STR' / 'CHAR' / 'func' signature block / hardtype literal / '(' expr ')' / conversion / 'NAME' / '(' type ')'
conversion = &('[' / 'map' / 'chan' / 'struct' / 'interface' / 'func' / '<-') type
hardtype = &('[' / 'map' / 'struct') type
littype = &('[' / 'map' / 'struct') type / 'NAME' ('.' 'NAME')? targs? &'{'
"""
    + _EXPRESSIONS.replace("S", "0")
    + _EXPRESSIONS.replace("S", "")
)
