"""Lexers and grammars of the languages whose files are checked: Solidity, Vyper, Python 3 and JSON.

Grammars say what is syntax and no more: operators have no precedence, names no meaning. Lexers give
(kind, line) pairs; a character that begins no token gives the kind ERROR, which no grammar knows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

from solstrata.llm.derivatives import Grammar

Tokens = tuple[list[str], list[int]]

_SOL_KEYWORDS = set(
    "abstract anonymous as assembly break case catch constant constructor continue contract default delete do else emit enum event external fallback false for from "
    "function global if immutable import indexed interface internal is leave let library mapping memory modifier new override payable private public pure receive "
    "return returns revert error storage calldata struct switch throw true try type unchecked using view virtual while transient layout at".split()
)
_SOL_UNITS = set("wei gwei szabo finney ether seconds minutes hours days weeks years".split())
_SOL_TOKEN = re.compile(
    r"""(?P<blank>[ \t\r\n\f ]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<pragma>pragma\s[^;{}]*;)
    |(?P<string>(?:unicode)?"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|(?:unicode)?'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')
    |(?P<hex>hex(?:"[0-9a-fA-F_]*"|'[0-9a-fA-F_]*'))
    |(?P<elem>(?:u?int(?:8|16|24|32|40|48|56|64|72|80|88|96|104|112|120|128|136|144|152|160|168|176|184|192|200|208|216|224|232|240|248|256)?|bytes(?:[1-9]|[12][0-9]|3[0-2])?|byte|u?fixed(?:\d+x\d+)?|address|bool|string|var)(?![A-Za-z0-9_$]))
    |(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)
    |(?P<number>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE]-?\d+(?:_\d+)*)?|\d+(?:_\d+)*\.?(?:[eE]-?\d+(?:_\d+)*)?)(?![A-Za-z0-9_$]))
    |(?P<mark>>>>=|<<=|>>=|>>>|\*\*|=>|->|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\|=|&=|\^=|<<|>>|[-+*/%<>=!~&|^?:;,.(){}\[\]])""",
    re.X,
)


def _lines(text: str) -> Callable[[int], int]:
    breaks = [m.start() for m in re.finditer("\n", text)]
    import bisect

    return lambda pos: bisect.bisect_left(breaks, pos) + 1


def solidity_tokens(text: str) -> Tokens:
    kinds, at, pos = [], [], 0
    match, n = _SOL_TOKEN.match, len(text)
    if text.startswith("﻿"):
        pos = 1
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append("ERROR")
            at.append(pos)
            break
        group = m.lastgroup
        if group == "word":
            word = m.group()
            kinds.append(word if word in _SOL_KEYWORDS else "UNIT" if word in _SOL_UNITS else "ID")
            at.append(pos)
        elif group == "mark":
            kinds.append(m.group())
            at.append(pos)
        elif group != "blank":
            kinds.append({"pragma": "PRAGMA", "string": "STRING", "hex": "HEX", "elem": "ELEM", "number": "NUMBER"}[group])
            at.append(pos)
        pos = m.end()
    return kinds, at


SOLIDITY = {
    "file": "item*",
    "item": "PRAGMA | import | using | contract | struct | enum | function | event | error | typedef | statevar",
    "ident": "ID | 'layout' | 'at' | 'from' | 'error' | 'revert' | 'global' | 'receive' | 'fallback' | 'transient' | 'leave' | 'let' | 'case' | 'switch' | 'default'",
    "path": "ident ('.' ident)*",
    "import": "'import' (STRING ('as' ident)? | ('*' | ident) ('as' ident)? 'from' STRING | '{' (alias (',' alias)* ','?)? '}' 'from' STRING) ';'",
    "alias": "ident ('as' ident)?",
    "contract": "('abstract'? 'contract' | 'interface' | 'library') ident ('is' base (',' base)* | 'layout' 'at' expr)* '{' member* '}'",
    "base": "path args?",
    "member": "using | struct | enum | function | constructor | modifier | special | event | error | typedef | statevar",
    "using": "'using' (path | '{' usedname (',' usedname)* '}') 'for' ('*' | type) 'global'? ';'",
    "usedname": "path ('as' anyop)?",
    "anyop": "'+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '~' | '==' | '!=' | '<' | '>' | '<=' | '>='",
    "struct": "'struct' ident '{' (type ident ';')* '}'",
    "enum": "'enum' ident '{' (ident (',' ident)*)? '}'",
    "typedef": "'type' ident 'is' ELEM 'payable'? ';'",
    "event": "'event' ident '(' (eventarg (',' eventarg)*)? ')' 'anonymous'? ';'",
    "eventarg": "type 'indexed'? ident?",
    "error": "'error' ident '(' (errorarg (',' errorarg)*)? ')' ';'",
    "errorarg": "type ident?",
    "function": "'function' ident? params funcmod* ('returns' params)? (';' | block)",
    "constructor": "'constructor' params funcmod* block",
    "special": "('fallback' | 'receive') params funcmod* ('returns' params)? (';' | block)",
    "modifier": "'modifier' ident params? ('virtual' | override)* (';' | block)",
    "funcmod": "'external' | 'public' | 'internal' | 'private' | 'pure' | 'view' | 'payable' | 'virtual' | 'constant' | override | path args?",
    "override": "'override' ('(' path (',' path)* ')')?",
    "params": "'(' (param (',' param)*)? ')'",
    "param": "type place? ident?",
    "place": "'memory' | 'storage' | 'calldata'",
    "type": "(ELEM 'payable'? | path | mapping | functype) ('[' expr? ']')*",
    "mapping": "'mapping' '(' type ident? '=>' type ident? ')'",
    "functype": "'function' params ('external' | 'internal' | 'public' | 'private' | 'pure' | 'view' | 'payable')* ('returns' params)?",
    "statevar": "type ('public' | 'private' | 'internal' | 'constant' | 'immutable' | 'transient' | override)* ident ('=' expr)? ';'",
    "block": "'{' statement* '}'",
    "statement": "block | 'unchecked' block | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement"
    " | 'for' '(' (simple | ';') expr? ';' expr? ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'continue' ';' | 'break' ';' | 'throw' ';'"
    " | 'return' expr? ';' | 'emit' expr ';' | 'revert' path args ';' | try | assembly | simple",
    "simple": "(local | expr) ';'",
    "local": "type place? ident ('=' expr)? | '(' locals ')' '=' expr",
    "locals": "(type place? ident)? (',' (type place? ident)?)*",
    "try": "'try' expr ('returns' params)? block catch catch*",
    "catch": "'catch' (ident? params)? block",
    "expr": "operand (binary operand | '?' expr ':' operand)*",
    "binary": "'+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>>' | '>>>' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||'"
    " | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '|=' | '&=' | '^=' | '<<=' | '>>=' | '>>>='",
    "operand": "('!' | '~' | '-' | '++' | '--' | 'delete')* primary suffix*",
    "suffix": "'[' expr? (':' expr?)? ']' | '.' (ident | ELEM) | args | '{' (named (',' named)*)? '}' | '++' | '--'",
    "args": "'(' (expr (',' expr)*)? ')' | '(' '{' (named (',' named)* ','?)? '}' ')'",
    "named": "ident ':' expr",
    "primary": "ident | NUMBER UNIT? | STRING STRING* | HEX HEX* | 'true' | 'false' | ELEM 'payable'? | 'payable' | 'type' | 'new' type | '(' expr? (',' expr?)* ')' | '[' expr (',' expr)* ']'",
    "assembly": "'assembly' STRING? ('(' STRING (',' STRING)* ')')? yulblock",
    "yulblock": "'{' yul* '}'",
    "yul": "yulblock | 'let' yulname (',' yulname)* (':=' yulexpr)? | yulpath (',' yulpath)* ':=' yulexpr | yulexpr | 'if' yulexpr yulblock | 'for' yulblock yulexpr yulblock yulblock"
    " | 'switch' yulexpr ('case' (NUMBER | STRING | HEX | 'true' | 'false') yulblock)* ('default' yulblock)? | 'leave' | 'break' | 'continue'"
    " | 'function' yulname '(' (yulname (',' yulname)*)? ')' ('->' yulname (',' yulname)*)? yulblock",
    "yulname": "ID | 'layout' | 'at' | ELEM | 'revert' | 'error' | 'from' | 'return' | 'receive' | 'fallback' | 'global' | 'type' | 'memory' | 'storage' | 'view' | 'public' | 'as' | 'is' | 'override' | 'indexed' | 'new' | 'delete' | 'external' | 'payable' | UNIT",
    "yulpath": "yulname ('.' (yulname | 'address'))*",
    "yulexpr": "yulpath ('(' (yulexpr (',' yulexpr)*)? ')')? | NUMBER | STRING | HEX | 'true' | 'false'",
}

_PY_STRING = (
    r"(?:(?i:[rbu]|br|rb|f|fr|rf)(?=['\"]))?(?:'''(?:[^\\']|\\[\s\S]|'(?!\'\'))*'''"
    r'|"""(?:[^\\"]|\\[\s\S]|"(?!""))*"""'
    r"|'(?!\'\')(?:[^\\'\n\r]|\\(?:\r\n|[\s\S]))*'" + r'|"(?!"")(?:[^\\"\n\r]|\\(?:\r\n|[\s\S]))*")'
)
# a digit may be followed by some keywords, as in `1if x else 2`
_PY_NUMBER = (
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?P<imag>(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][-+]?\d(?:_?\d)*)?[jJ])"
    r"|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][-+]?\d(?:_?\d)*)?|\d(?:_?\d)*\.(?:[eE][-+]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][-+]?\d(?:_?\d)*|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?!\.))"
    r"(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b))"
)
_PY_TOKEN = re.compile(
    rf"(?P<blank>[ \t\f]+|\\\r?\n(?=[\s\S])|#[^\n\r]*)|(?P<line>\r?\n|\r)|(?P<fstart>(?i:f|fr|rf)(?:'''|\"\"\"|'|\"))|(?P<string>{_PY_STRING})|(?P<number>{_PY_NUMBER})|(?P<word>(?:[A-Za-z_]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)"
    r"|(?P<mark>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
_PY_KEYWORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield match case type _".split()
)
_VY_KEYWORDS = set(
    "False None True and as assert break continue def elif else for from if import in not or pass raise return log event struct interface enum flag implements "
    "class while try with lambda yield del global nonlocal async await is except finally uses initializes exports extcall staticcall".split()
)
_PY_STRING_TOKEN = re.compile(_PY_STRING)
_CONVERSION = re.compile(r"![sra](?!\w)")
_INDENT = re.compile(r"[ \t\f]*")
_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}|N\{(?P<name>[^{}]+)\}|(?P<cut>[xuUN])|[\s\S])")


def _sound_escapes(body: str, is_bytes: bool) -> bool:
    """Whether the escapes of a string that is not raw can be read."""
    for m in _ESCAPE.finditer(body):
        if m["cut"] and (m["cut"] == "x" or not is_bytes):
            return False
        if m["name"] and not is_bytes:
            try:
                unicodedata.lookup(m["name"])
            except KeyError:
                return False
    return True


def _string_kind(literal: str) -> str:
    """STRING or BYTES, or ERROR where a literal has escapes or characters it may not have."""
    at = min(i for i in (literal.find("'"), literal.find('"')) if i >= 0)
    prefix = literal[:at].lower()
    width = 3 if literal[at : at + 3] in ("'''", '"""') and len(literal) >= at + 6 else 1
    body = literal[at + width : -width]
    is_bytes = "b" in prefix
    if is_bytes and not body.isascii():
        return "ERROR"
    if "r" not in prefix and "\\" in body and not _sound_escapes(body, is_bytes):
        return "ERROR"
    return "BYTES" if is_bytes else "STRING"


class _Format:
    """An f-string the lexer is in: its quote, how deep brackets were where its field began, and whether it is in a format."""

    __slots__ = ("quote", "raw", "fields")

    def __init__(self, quote: str, raw: bool):
        self.quote, self.raw = quote, raw
        self.fields: list[list] = []  # of the fields it is in: bracket depth inside, and whether its format has begun

    def in_text(self) -> bool:
        return not self.fields or self.fields[-1][1]


def _format_text(text: str, pos: int, f: _Format) -> tuple[int, str | None]:
    """From pos in the text of an f-string (or of a format in it) to what ends it: its place and kind ({, }, END, or None for an error)."""
    start, n, spec = pos, len(text), bool(f.fields)
    while pos < n:
        c = text[pos]
        if text.startswith(f.quote, pos):
            return (pos, "END") if not spec and _fit(text[start:pos], f.raw) else (pos, None)
        if c in "\r\n" and (len(f.quote) == 1 or spec):
            return pos, None
        if c == "\\" and not (text[pos + 1 : pos + 2] in ("{", "}")):
            if not f.raw and text.startswith("\\N{", pos):
                pos = text.find("}", pos) + 1 or n
            else:
                pos += 3 if text.startswith("\\\r\n", pos) else 2
            continue
        if c in "{}":
            if not spec and text.startswith(c * 2, pos):
                pos += 2
                continue
            if c == "}" and not spec:
                return pos, None
            return (pos, c) if _fit(text[start:pos], f.raw) else (pos, None)
        pos += 1
    return n, None


def _fit(body: str, raw: bool) -> bool:
    return raw or "\\" not in body or _sound_escapes(body, False)


def _indented_tokens(text: str, keywords: set[str], python: bool) -> Tokens:
    kinds: list[str] = []
    at: list[int] = []
    match, n, pos = _PY_TOKEN.match, len(text), 1 if text.startswith("﻿") else 0
    indents, depth, fresh = [(0, 0)], 0, True
    formats: list[_Format] = []

    def put(kind: str, where: int) -> None:
        kinds.append(kind)
        at.append(where)

    while pos < n:
        if formats and formats[-1].in_text():
            f = formats[-1]
            pos, what = _format_text(text, pos, f)
            if what is None:
                if pos < n:
                    put("ERROR", pos)
                    return kinds, at
                depth += 1  # the text ends inside the f-string
                break
            if what == "END":
                formats.pop()
                put("FEND", pos)
                pos += len(f.quote)
            elif what == "{":
                depth += 1
                f.fields.append([depth, False])
                put("{", pos)
                pos += 1
            else:
                f.fields.pop()
                depth -= 1
                put("}", pos)
                pos += 1
            continue
        if fresh and not depth:
            m = _INDENT.match(text, pos)
            rest = m.end()
            if rest < n and text[rest] not in "\r\n#":
                blank = m.group().rsplit("\f", 1)[-1]
                width = (len(blank.expandtabs(8)), len(blank))
                if width[0] > indents[-1][0]:
                    if python and width[1] <= indents[-1][1]:  # tabs and blanks that only agree at one width of a tab
                        put("ERROR", rest)
                        return kinds, at
                    indents.append(width)
                    put("INDENT", rest)
                while width[0] < indents[-1][0]:
                    indents.pop()
                    put("DEDENT", rest)
                if width[0] != indents[-1][0] or python and width[1] != indents[-1][1]:
                    put("ERROR", rest)
                    return kinds, at
            pos, fresh = rest, False
            if pos >= n:
                break
        inner = formats[-1] if formats else None
        if inner is not None and inner.fields[-1][0] == depth:
            c = text[pos]
            if c == "!" and text[pos + 1 : pos + 2] != "=":
                m = _CONVERSION.match(text, pos)
                put("CONVERSION" if m else "ERROR", pos)
                pos += 2
                continue
            if c == ":":
                put("FORMAT", pos)
                inner.fields[-1][1] = True
                pos += 1
                continue
            if c == "}":
                inner.fields.pop()
                depth -= 1
                put("}", pos)
                pos += 1
                continue
        m = match(text, pos)
        if m is None:
            put("ERROR", pos)
            return kinds, at
        group = m.lastgroup
        if group == "imag":
            group = "number"
        word = m.group()
        if group == "fstart" and not python:
            m = _PY_STRING_TOKEN.match(text, pos)
            if m is None:
                put("ERROR", pos)
                return kinds, at
            group, word = "string", m.group()
        if group == "line":
            fresh = not depth
            if fresh and kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                put("NEWLINE", pos)
        elif group == "fstart":
            quote = word.lstrip("fFrR")
            formats.append(_Format(quote, "r" in word.lower()))
            put("FSTART", pos)
        elif group != "blank":
            if group == "mark":
                put(word, pos)
                if word in "([{":
                    depth += 1
                elif word in ")]}":
                    depth = max(0, depth - 1)
            elif group == "word":
                put(word if word in keywords else "NAME" if word.isascii() or word.isidentifier() else "ERROR", pos)
            elif group == "string":
                put(_string_kind(word) if python else "STRING", pos)
            else:
                put("IMAG" if python and word[-1] in "jJ" else "NUMBER", pos)
        pos = m.end()
    if depth == 0:  # inside brackets the text ends too early, and no line end may hide that
        if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
            put("NEWLINE", n)
        for _ in indents[1:]:
            put("DEDENT", n)
    return kinds, at


def python_tokens(text: str) -> Tokens:
    return _indented_tokens(text, _PY_KEYWORDS, True)


def vyper_tokens(text: str) -> Tokens:
    return _indented_tokens(text, _VY_KEYWORDS, False)


PYTHON = {
    "file": "(statement | NEWLINE)*",
    # expressions
    "name": "NAME | 'match' | 'case' | 'type' | '_'",
    "test": "lambda | logic ('if' logic 'else' test)?",
    "logic": "'not'* compared (('and' | 'or') 'not'* compared)*",
    "compared": "bits (comparison bits)*",
    "comparison": "'<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?",
    "bits": "factor (binop factor)*",
    "binop": "'+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^'",
    "factor": "('+' | '-' | '~')* 'await'? atom trailer*",
    "lambda": "'lambda' lparams? ':' test",
    "trailer": "'(' callargs? ')' | '[' subscripts ']' | '.' name",
    "callargs": "arguments | named comp",
    "arguments": "posarg (',' posarg)* (',' keyargs)? ','? | keyargs ','?",
    "posarg": "'*' test | named",
    "keyargs": "keystar (',' keystar)* (',' keydouble (',' keydouble)*)? | keydouble (',' keydouble)*",
    "keystar": "name '=' test | '*' test",
    "keydouble": "name '=' test | '**' test",
    "subscripts": "subscript (',' (subscript | '*' test))* ','? | '*' test (',' (subscript | '*' test))* ','?",
    "subscript": "named | test? ':' test? (':' test?)?",
    "named": "test | name ':=' test",
    "star": "test | '*' bits",
    "stars": "star (',' star)* ','?",
    "starnamed": "named | '*' bits",
    "starnameds": "starnamed (',' starnamed)* ','?",
    "comp": "compfor compfor*",
    "compfor": "'async'? 'for' targets 'in' logic ('if' logic)*",
    "strings": "(STRING | fstring) (STRING | fstring)* | BYTES BYTES*",
    "fstring": "FSTART field* FEND",
    "field": "'{' (yield | stars) '='? CONVERSION? (FORMAT field*)? '}'",
    "number": "NUMBER | IMAG",
    "atom": "name | number | strings | '...' | 'None' | 'True' | 'False' | '(' inparens? ')' | '[' (starnameds | named comp)? ']' | '{' braced? '}'",
    "inparens": "yield | named comp? | starnamed ',' starnameds?",
    "braced": "dictitem (',' dictitem)* ','? | test ':' test comp | starnameds | named comp",
    "dictitem": "test ':' test | '**' bits",
    "yield": "'yield' ('from' test | stars)?",
    # what can be assigned to, deleted or annotated
    "place": "atom trailer* ('.' name | '[' subscripts ']')",
    "target": "name | place | '(' target ')' | '(' (startarget ',' targets?)? ')' | '[' targets? ']'",
    "startarget": "'*'? target",
    "targets": "startarget (',' startarget)* ','?",
    "single": "name | place | '(' single ')'",
    "deltarget": "name | place | '(' deltarget ')' | '(' deltargets? ')' | '[' deltargets? ']'",
    "deltargets": "deltarget (',' deltarget)* ','?",
    # statements
    "statement": "simples | compound",
    "simples": "simple (';' simple)* ';'? NEWLINE",
    "simple": "assign | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)*"
    " | 'del' deltargets | 'assert' test (',' test)? | import | 'type' name typeparams? '=' test",
    "assign": "stars | yield | targets '=' (targets '=')* (yield | stars) | single ':' test ('=' (yield | stars))? | single augmented (yield | stars)",
    "augmented": "'+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='",
    "import": "'import' dottedas (',' dottedas)* | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...') ('.' | '...')* 'import' imported",
    "imported": "'*' | importas (',' importas)* | '(' importas (',' importas)* ','? ')'",
    "importas": "name ('as' name)?",
    "dotted": "name ('.' name)*",
    "dottedas": "dotted ('as' name)?",
    "block": "simples | NEWLINE INDENT statement statement* DEDENT",
    "compound": "if | while | for | try | with | decorated | match | 'async' (with | for)",
    "if": "'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?",
    "while": "'while' named ':' block ('else' ':' block)?",
    "for": "'for' targets 'in' stars ':' block ('else' ':' block)?",
    "try": "'try' ':' block ((except except* | group group*) ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)",
    "except": "'except' (test ('as' name)?)? ':' block",
    "group": "'except' '*' test ('as' name)? ':' block",
    "with": "'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block",
    "withitem": "test ('as' startarget)?",
    "decorated": "('@' named NEWLINE)* ('async'? def | class)",
    "def": "'def' name typeparams? '(' params? ')' ('->' test)? ':' block",
    "class": "'class' name typeparams? ('(' arguments? ')')? ':' block",
    "typeparams": "'[' typeparam (',' typeparam)* ','? ']'",
    "typeparam": "name (':' test)? ('=' test)? | '*' name ('=' star)? | '**' name ('=' test)?",
    # parameters: without default, then with, a slash once, then the starred ones
    "plain": "name (':' test)?",
    "filled": "name (':' test)? '=' test",
    "params": "positional (',' starred)? ','? | starred ','?",
    "positional": "plain (',' plain)* (',' filled)* | plain (',' plain)* ',' '/' (',' plain)* (',' filled)* | plain (',' plain)* ',' filled (',' filled)* ',' '/' (',' filled)*"
    " | filled (',' filled)* (',' '/' (',' filled)*)?",
    "starred": "'*' name (':' star)? (',' (plain | filled))* (',' '**' plain)? | '*' ',' (plain | filled) (',' (plain | filled))* (',' '**' plain)? | '**' plain",
    "lfilled": "name '=' test",
    "lparams": "lpositional (',' lstarred)? ','? | lstarred ','?",
    "lpositional": "name (',' name)* (',' lfilled)* | name (',' name)* ',' '/' (',' name)* (',' lfilled)* | name (',' name)* ',' lfilled (',' lfilled)* ',' '/' (',' lfilled)*"
    " | lfilled (',' lfilled)* (',' '/' (',' lfilled)*)?",
    "lstarred": "'*' name (',' (name | lfilled))* (',' '**' name)? | '*' ',' (name | lfilled) (',' (name | lfilled))* (',' '**' name)? | '**' name",
    # patterns
    "match": "'match' (named | starnamed ',' starnameds?) ':' NEWLINE INDENT case case* DEDENT",
    "case": "'case' (pattern | maybestar ',' seqitems?) ('if' named)? ':' block",
    "capture": "NAME | 'match' | 'case' | 'type'",
    "maybestar": "pattern | '*' name",
    "seqitems": "maybestar (',' maybestar)* ','?",
    "pattern": "closed ('|' closed)* ('as' capture)?",
    "literal": "'-'? number | '-'? NUMBER ('+' | '-') IMAG | (STRING | fstring) (STRING | fstring)* | BYTES BYTES* | 'None' | 'True' | 'False'",
    "closed": "literal | dotted | dotted '(' patargs? ')' | '(' (pattern | maybestar ',' seqitems?)? ')' | '[' seqitems? ']' | '{' mapping? '}'",
    "patargs": "pattern (',' pattern)* (',' keypat)* ','? | keypat (',' keypat)* ','?",
    "keypat": "name '=' pattern",
    "mapping": "mapitem (',' mapitem)* (',' '**' capture)? ','? | '**' capture ','?",
    "mapitem": "(literal | name '.' dotted) ':' pattern",
}

VYPER = {
    "file": "(item | NEWLINE)*",
    "item": "import | implements | event | struct | interface | enum | variable | function | docstring",
    "name": "NAME | 'event' | 'struct' | 'interface' | 'enum' | 'flag' | 'implements' | 'log' | 'uses' | 'initializes' | 'exports'",
    "docstring": "STRING NEWLINE",
    "import": "('import' dotted ('as' name)? | 'from' '.'* dotted? 'import' (name ('as' name)? (',' name ('as' name)?)* | '*')) NEWLINE",
    "dotted": "name ('.' name)*",
    "implements": "('implements' | 'uses' | 'initializes' | 'exports') ':' expr NEWLINE",
    "event": "'event' name ':' (('pass' NEWLINE) | NEWLINE INDENT (docstring | 'pass' NEWLINE | name ':' expr NEWLINE) (docstring | 'pass' NEWLINE | name ':' expr NEWLINE)* DEDENT)",
    "struct": "'struct' name ':' NEWLINE INDENT docstring? field field* DEDENT",
    "field": "name ':' expr NEWLINE",
    "interface": "'interface' name ':' NEWLINE INDENT signature signature* DEDENT",
    "signature": "'def' name '(' params? ')' ('->' expr)? ':' name NEWLINE",
    "enum": "('enum' | 'flag') name ':' NEWLINE INDENT name NEWLINE (name NEWLINE)* DEDENT",
    "variable": "name ':' expr ('=' expr)? NEWLINE",
    "function": "('@' name ('(' arguments? ')')? NEWLINE)* 'def' name '(' params? ')' ('->' expr)? ':' block",
    "params": "param (',' param)* ','?",
    "param": "name ':' expr ('=' expr)?",
    "block": "simples | NEWLINE INDENT statement statement* DEDENT",
    "statement": "simples | if | for",
    "simples": "simple (';' simple)* ';'? NEWLINE",
    "simple": "'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' expr? | 'assert' expr (',' expr)? | 'log' expr | assign",
    "assign": "exprs (':' expr ('=' exprs)? | augmented expr | ('=' exprs)?)",
    "augmented": "'+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='",
    "if": "'if' expr ':' block ('elif' expr ':' block)* ('else' ':' block)?",
    "for": "'for' name (':' expr)? 'in' expr ':' block",
    "exprs": "expr (',' expr)* ','?",
    "expr": "unary (binop unary)* ('if' unary (binop unary)* 'else' expr)?",
    "binop": "'+' | '-' | '*' | '/' | '//' | '%' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'and' | 'or'",
    "unary": "('+' | '-' | '~' | 'not' | 'extcall' | 'staticcall')* atom trailer*",
    "trailer": "'(' arguments? ')' | '[' exprs ']' | '.' name",
    "arguments": "argument (',' argument)* ','?",
    "argument": "expr | name '=' expr",
    "atom": "name | NUMBER | STRING STRING* | '...' | 'None' | 'True' | 'False' | '(' exprs? ')' | '[' exprs? ']' | '{' (entry (',' entry)* ','?)? '}'",
    "entry": "expr ':' expr",
}

_JSON_TOKEN = re.compile(
    r'(?P<blank>[ \t\r\n]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![A-Za-z0-9_.]))|(?P<word>(?:true|false|null)(?![A-Za-z0-9_]))|(?P<mark>[\[\]{},:])"
)


def json_tokens(text: str) -> Tokens:
    kinds, at, pos = [], [], 0
    n = len(text)
    while pos < n:
        m = _JSON_TOKEN.match(text, pos)
        if m is None:
            kinds.append("ERROR")
            at.append(pos)
            break
        group = m.lastgroup
        if group != "blank":
            kinds.append(m.group() if group == "mark" else "STRING" if group == "string" else "SCALAR")
            at.append(pos)
        pos = m.end()
    return kinds, at


JSON = {
    "file": "value",
    "value": "STRING | SCALAR | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']'",
    "pair": "STRING ':' value",
}

#: Language by extension, and how its files are read.
LANGUAGES: dict[str, tuple[str, Callable[[str], Tokens], dict[str, str]]] = {
    "sol": ("Solidity", solidity_tokens, SOLIDITY),
    "vy": ("Vyper", vyper_tokens, VYPER),
    "py": ("Python", python_tokens, PYTHON),
    "json": ("JSON", json_tokens, JSON),
}


@functools.lru_cache(maxsize=None)
def grammar(extension: str) -> Grammar:
    return Grammar(LANGUAGES[extension][2], "file")


def check(extension: str, text: str) -> tuple[str, int | None, str | None]:
    """('ok', None, None), or 'broken' with line and kind of the token that can't stand there, or 'truncated' with the last line."""
    _, tokens, _ = LANGUAGES[extension]
    kinds, at = tokens(text)
    g = grammar(extension)
    numbers = g.tokens
    failed = g.run([numbers[k] if k in numbers else g.token(k) for k in kinds])
    if failed is None:
        return "ok", None, None
    line = _lines(text)
    if failed >= len(kinds):
        return "truncated", line(len(text)), None
    return "broken", line(at[failed]), kinds[failed]
