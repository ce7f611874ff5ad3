"""ECMAScript 2022 modules. Semicolons are inserted by the grammar, from the line ends that the lexer notes."""

from __future__ import annotations

import re

from pinloom.llm.peg import Grammar, Tokens

#: The reserved words of module code. ``await`` and ``yield`` are operators here.
KEYWORDS = frozenset(
    """await break case catch class const continue debugger default delete do else enum export extends false finally for function if
    implements import in instanceof interface let new null package private protected public return static super switch this throw true
    try typeof var void while with yield""".split()
)
_NAME = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    rf"""[ \t]*+(?:(?P<space>[\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<NL>\r\n|[\n\r\u2028\u2029])
    |(?P<comment>//[^\n\r\u2028\u2029]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<NAME>{_NAME})|(?P<PRIVATE>\#{_NAME})
    |(?P<NUM>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?
      |(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)
    |(?P<STR>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+')|(?P<tick>`)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|>>|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@]))""",
    re.X,
)
_BLANK = re.compile(r"[ \t]*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/(?:\w|\$)*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|0[0-9]|[1-9])")
_FLAGS = re.compile(r"(?!.*(.).*\1)[dgimsuy]*\Z")
_VALUE_END = frozenset(["NAME", "NUM", "STR", "TPL", "TTAIL", "REGEX", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])
#: Words after which a name is expected, so that a reserved one is a name too.
_MEMBER = frozenset([".", "?."])
#: Signs whose meaning, or that of what follows, depends on where they stand.
_STATEFUL = frozenset(["/", "/=", "(", ")", "[", "]", "{", "}"])
_BEFORE_BLOCK = frozenset([")", ";", "{", "}", "else", "do", "try", "finally", "=>", ":", "$", "static"])


def lex(text: str) -> tuple[Tokens, dict[int, bool]]:
    """The tokens, and the opening brackets after whose partner an arrow stands."""
    out, pos, n = Tokens(), 0, len(text)
    kinds = out.kinds
    newline, spaced = True, True
    brackets: list[tuple[str, int, bool]] = []  # kind, token, whether a regex may follow the partner
    partner: dict[int, int] = {}
    regex_after: dict[int, bool] = {}

    def bad(place: int, why: str) -> None:
        out.add("BAD", text[place : place + 1], place, newline)
        out.problem = why

    if text.startswith("#!"):
        pos = m.start() if (m := re.search(r"[\n\r\u2028\u2029]", text)) else n
    match, texts, offsets, newlines, joined = _TOKEN.match, out.texts, out.offsets, out.newline, out.joined
    while pos < n:
        m = match(text, pos)
        if not m:
            pos = _BLANK.match(text, pos).end()
            if pos < n:
                bad(pos, "string" if text[pos] in "\"'" else "character")
            break
        kind = m.lastgroup
        word, start, end = m.group(kind), m.start(kind), m.end()
        if start > pos:
            spaced, pos = True, start
        if kind == "space":
            pos = end
            spaced = True
            continue
        if kind == "NL":
            newline, pos = True, end
            continue
        if kind == "comment":
            out.comments.append((pos, end))
            pos = end
            continue
        if kind == "block":
            out.comments.append((pos, end))
            newline = newline or "\n" in word or "\r" in word or "\u2028" in word
            pos = end
            continue
        if kind == "op" and word not in _STATEFUL:
            kinds.append(word), texts.append(word), offsets.append(pos), newlines.append(newline), joined.append(not spaced)
            newline = spaced = False
            pos = end
            continue
        last = kinds[-1] if kinds else "$"
        token = word if kind == "op" else kind
        if kind == "NAME":
            if "\\" in word and re.search(r"\\u\{0*(?:1[1-9a-fA-F]|[2-9a-fA-F][0-9a-fA-F])[0-9a-fA-F]{4,}\}", word):
                bad(pos, "character")
                break
            token = word if word in KEYWORDS else "NAME"
        elif kind == "NUM":
            if end < n and (text[end].isalnum() or text[end] in "_$\\"):
                bad(pos, "number")
                break
        elif kind == "STR":
            if "\\" in word and _BAD_ESCAPE.search(word):
                bad(pos, "string")
                break
        elif kind == "tick" or (word == "}" and brackets and brackets[-1][0] == "${"):
            if word == "}":
                brackets.pop()
            m2 = _TEMPLATE.match(text, end)
            stop = m2.end()
            if stop >= n:
                bad(pos, "string")
                break
            head = text[stop] == "$"
            token = ("THEAD" if head else "TPL") if kind == "tick" else ("TMID" if head else "TTAIL")
            end = stop + 2 if head else stop + 1
            if head:
                brackets.append(("${", len(kinds), False))
        elif kind == "op":
            if word in ("/", "/=") and (last not in _VALUE_END or (last in (")", "}") and regex_after.get(len(kinds) - 1, False))):
                m2 = _REGEX.match(text, pos)
                if not m2 or not _FLAGS.match(m2.group().rpartition("/")[2]):
                    bad(pos, "regex")
                    break
                token, end = "REGEX", m2.end()
            elif word in "([":
                before = last in ("if", "while", "for", "with") and (len(kinds) < 2 or kinds[-2] not in _MEMBER)
                brackets.append((word, len(kinds), before))
            elif word == "{":
                # after a block a regex may stand, after an object literal a division
                brackets.append((word, len(kinds), last in _BEFORE_BLOCK and not (last == ":" and brackets and brackets[-1][0] == "{" and not brackets[-1][2])))
            elif word in ")]}":
                if not brackets or {"(": ")", "[": "]", "{": "}"}.get(brackets[-1][0]) != word:
                    bad(pos, "bracket")
                    break
                _, at, regex = brackets.pop()
                partner[at] = len(kinds)
                regex_after[len(kinds)] = regex
        kinds.append(token), texts.append(word), offsets.append(pos), newlines.append(newline), joined.append(not spaced)
        newline = spaced = False
        pos = end
    out.add("$", "", n, True)
    arrows = {a: kinds[b + 1] == "=>" for a, b in partner.items()}
    return out, _Arrows(arrows)


class _Arrows(dict):
    def __missing__(self, key: int) -> bool:
        return False


_WORDS = " / ".join(f"'{w}'" for w in sorted(KEYWORDS))

GRAMMAR = Grammar(
    f"""
module = item* '$'
item = import / export / statement
end = ';' / &'}}' / #nl / &'$'
import = 'import' !'(' !'.' ('STR' / clause "from" 'STR') assertion? end
assertion = #nonl "assert" object
clause = 'NAME' (',' (namespace / names))? / namespace / names
namespace = '*' "as" 'NAME'
names = '{{' (list<spec> ','?)? '}}'
spec = exported ("as" exported)?
exported = word / 'STR'
export = 'export' ('*' ("as" exported)? "from" 'STR' end / names ("from" 'STR')? end / 'default' (function / class / asyncfn / assign end) / variable / function / class / asyncfn)
word = 'NAME' / {_WORDS}

statement = block / variable / function / class / asyncfn / ';' / if / for / while / dowhile
  / 'continue' (#nonl 'NAME')? end / 'break' (#nonl 'NAME')? end / 'return' (#nonl expression)? end / 'throw' #nonl expression end
  / switch / try / 'debugger' end / 'NAME' ':' statement / !('{{' / 'function' / 'class') expression end
block = '{{' statement* '}}'
variable = 'const' list<constant> end / ('let' / 'var') list<binding ('=' assign)?> end
constant = named '=' arrow / named '=' assign / binding '=' assign
named@ = 'NAME' &('=' arrow)
binding! = 'NAME' / pattern
pattern = '[' (',' / binding ('=' assign)? &(',' / ']') / '...' binding &']')* ']' / '{{' (list<property> ','?)? '}}'
property = '...' binding / key ':' binding ('=' assign)? / 'NAME' ('=' assign)?
if = 'if' '(' expression ')' statement ('else' statement)?
for = 'for' ('await')? '(' (('let' / 'const' / 'var') binding ("of" assign / 'in' expression) / ('let' / 'const' / 'var') list<binding ('=' assignnoin)?> ';' expression? ';' expression?
  / target ("of" assign / 'in' expression) / list<assignnoin>? ';' expression? ';' expression?) ')' statement
while = 'while' '(' expression ')' statement
dowhile = 'do' statement 'while' '(' expression ')' ';'?
switch = 'switch' '(' expression ')' '{{' (('case' expression / 'default') ':' statement*)* '}}'
try = 'try' block ('catch' ('(' binding ')')? block ('finally' block)? / 'finally' block)
function = 'function' '*'? fname params block
fname@ = 'NAME'
asyncfn = "async" #nonl 'function' '*'? fname params block
params = '(' (list<binding ('=' assign)? &(',' / ')')>? (','? '...' binding)? ','?) ')'
class = 'class' 'NAME' ('extends' lhs)? body
body = '{{' member* '}}'
member = ';' / 'static' block / 'static'? method / 'static'? field
method = (modifier)* mname params block
modifier = ("async" #nonl '*'? / "get" / "set" / '*') &mkey
mname@ = mkey &'('
mkey = word / 'STR' / 'NUM' / 'PRIVATE' / '[' assign ']'
field = mkey ('=' assign)? end
key = word / 'STR' / 'NUM' / '[' assign ']'

expression! = assign (',' assign)*
assign! = arrow / 'yield' (#nonl '*' assign / #nonl !'}}' !')' !']' !',' !';' !':' !'$' assign)? / target aop assign / conditional
aop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '^=' / '|=' / '&&=' / '||=' / '??='
target! = !(('NUM' / 'STR' / 'this' / 'null' / 'true' / 'false' / 'TPL' / 'REGEX') aop) lhs
arrow! = ("async" #nonl)? ('NAME' / #arrow params) #nonl '=>' ('{{' statement* '}}' / assign)
conditional = binary ('?' assign ':' assign)?
binary = unary (bop unary)*
bop = '*' / '/' / '%' / '+' / '-' / '<<' / '>>' / '>>>' / '<' / '>' / '<=' / '>=' / 'instanceof' / 'in' / '==' / '!=' / '===' / '!==' / '&' / '^' / '|' / '&&' / '||' / '??' / '**'
assignnoin = target aop assignnoin / unary (bopnoin unary)* ('?' assign ':' assignnoin)?
bopnoin = !'in' bop
unary = 'PRIVATE' &'in' / ('++' / '--') unary / ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / 'await') unary !'**' / lhs (#nonl ('++' / '--'))?
lhs! = ('new' newtail / 'super' &('(' / '.' / '[') / 'import' ('(' assign ','? ')' / '.' "meta") / primary) suffix*
newtail = '.' "target" / 'new' newtail / ('super' / 'import' '.' "meta" / primary) ('.' (word / 'PRIVATE') / '[' expression ']' / template)* ('(' args ')')?
suffix = '.' (word / 'PRIVATE') / '?.' ('(' args ')' / '[' expression ']' / word / 'PRIVATE') / '[' expression ']' / '(' args ')' / template
args = (list<'...'? assign> ','?)?
template = 'TPL' / 'THEAD' expression ('TMID' expression)* 'TTAIL'
primary = 'this' / functionx / classx / asyncx / 'NAME' / 'NUM' / 'STR' / 'REGEX' / 'null' / 'true' / 'false' / template / array / object / '(' expression ')'
functionx = 'function' '*'? 'NAME'? params block
asyncx = "async" #nonl 'function' '*'? 'NAME'? params block
classx = 'class' 'NAME'? ('extends' lhs)? body
array = '[' (',' / '...'? assign &(',' / ']'))* ']'
object = '{{' (list<prop> ','?)? '}}'
prop = '...' assign / method / key ':' assign / 'NAME' ('=' assign)?
"""
)
