"""Declarations and bodies of Solidity and Vyper texts.

Comments and strings are blanked first (same length, so places stay), then declarations are found by pattern and
their bodies by matching braces. So a brace in a comment or string counts for nothing, headers may span lines, and a
body may be on one line.
"""

from __future__ import annotations

import bisect
import re

_HIDE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_DECLARED = re.compile(
    r"\b(?:(?P<abstract>abstract)\s+)?(?P<kind>contract|interface|library)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:is\s+(?P<bases>[^{};]*))?(?=\{)"
    r"|\b(?P<fn>function)\s+(?P<fname>[A-Za-z_$][\w$]*)?\s*(?=\()|\b(?P<ctor>constructor)\s*(?=\()|\b(?P<mod>modifier)\s+(?P<mname>[A-Za-z_$][\w$]*)"
    r"|(?<![\w.$])(?P<special>receive|fallback)\s*(?=\(\s*\))"
)
# Words of a signature that are no modifiers.
_SIGNATURE_WORDS = set("public external internal private pure view payable constant virtual override returns memory storage calldata".split())
_STATE_VAR = re.compile(
    r"^(?P<type>mapping\s*\(.*\)|(?:u?int\d*|address(?:\s+payable)?|bool|string|bytes\d*|byte|[A-Za-z_$][\w$.]*)(?:\s*\[[^\]]*\])*)\s+"
    r"(?P<flags>(?:(?:public|private|internal|constant|immutable|transient|override(?:\s*\([^)]*\))?)\s+)*)(?P<name>[A-Za-z_$][\w$]*)\s*(?:=.*)?$",
    re.S,
)
_REGION = re.compile(r"\b(?P<kind>unchecked|assembly)\b[^{};]*(?=\{)")
_NOT_VARS = re.compile(r"^(?:using|event|error|struct|enum|function|modifier|constructor|import|type|return|emit|pragma)\b")

BLOCK_FIELDS = (
    "kind string, name string, contract string, contract_kind string, is_abstract boolean, bases array<string>, signature string, visibility string, "
    "mutability string, modifiers array<string>, params array<struct<type:string,name:string>>, is_virtual boolean, is_override boolean, "
    "start_line int, end_line int, body_line int, has_body boolean, body string, code string"
)
VAR_FIELDS = "contract string, name string, type string, visibility string, is_constant boolean, is_immutable boolean, line int"


def blank(text: str) -> str:
    """text with comments and the insides of strings blanked; line ends stay."""

    def hide(m: re.Match) -> str:
        s = m.group()
        keep = s[0] in "\"'" and len(s) > 1
        inner = re.sub(r"[^\n]", " ", s[1:-1] if keep else s)
        return s[0] + inner + s[-1] if keep else inner

    return _HIDE.sub(hide, text)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts of text between marks that are in no bracket."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == mark and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def _close(text: str, at: int, pair: str) -> int:
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(text)


def _params(text: str) -> list[dict]:
    out = []
    for part in split_top(text):
        words = re.sub(r"\b(memory|storage|calldata|indexed|payable)\b", " ", part).split()
        if words:
            named = len(words) > 1 and re.fullmatch(r"[A-Za-z_$][\w$]*", words[-1])
            out.append({"type": "".join(words[:-1] if named else words), "name": words[-1] if named else ""})
    return out


def blocks(text: str) -> list[dict]:
    """All contracts, interfaces, libraries, functions, modifiers, constructors, and receive and fallback functions of a text."""
    code = blank(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda pos: bisect.bisect_left(breaks, pos) + 1
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    out, holders = [], []
    for m in _DECLARED.finditer(code):
        while holders and holders[-1][0] < m.start():
            holders.pop()
        got = m.groupdict()
        if got["kind"]:
            start = code.index("{", m.end())
            end = pairs.get(start, len(code) - 1)
            bases = [re.sub(r"\s*\(.*", "", b, flags=re.S).strip() for b in split_top(got["bases"] or "")]
            row = dict(kind=got["kind"], name=got["name"], contract=got["name"], contract_kind=got["kind"], is_abstract=bool(got["abstract"]), bases=bases, visibility="", mutability="",
                       modifiers=[], params=[], is_virtual=False, is_override=False)
            holders.append((end, got["name"], got["kind"], bool(got["abstract"])))
            has_body = True
            signature = text[m.start() : start]
        else:
            kind = "function" if got["fn"] else "constructor" if got["ctor"] else "modifier" if got["mod"] else got["special"]
            head = re.compile(r"[{;]").search(code, _close(code, m.end(), "()") if code[m.end() : m.end() + 1] == "(" else m.end())
            stop = head.start() if head else len(code)
            has_body = bool(head) and head.group() == "{"
            if kind == "function" and not got["fname"] and not has_body and not (head and head.group() == ";" and holders and code[m.start() - 1 : m.start()].strip() == ""):
                continue
            start = stop
            end = pairs.get(stop, len(code) - 1) if has_body else stop
            text_head = code[m.end() : stop]
            open_ = text_head.find("(")
            close = _close(text_head, open_, "()") if open_ >= 0 else -1
            tail = text_head[close + 1 :] if close >= 0 else text_head
            before_returns = re.split(r"\breturns\b", tail)[0]
            words = re.findall(r"[A-Za-z_$][\w$.]*", re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", " ", before_returns))
            pick = lambda names, default="": next((w for w in words if w in names), default)
            row = dict(kind=kind, name=got["fname"] or got["mname"] or ("" if kind == "function" else kind), contract=holders[-1][1] if holders else "", contract_kind=holders[-1][2] if holders else "",
                       is_abstract=holders[-1][3] if holders else False, bases=[], visibility=pick(("public", "external", "internal", "private")), mutability=pick(("pure", "view", "payable", "constant")),
                       modifiers=[w for w in words if w not in _SIGNATURE_WORDS], params=_params(text_head[open_ + 1 : close]) if open_ >= 0 else [], is_virtual="virtual" in words,
                       is_override="override" in words)
            signature = text[m.start() : stop]
        row |= dict(signature=re.sub(r"\s+", " ", blank(signature)).strip(), start_line=line(m.start()), end_line=line(end), body_line=line(start), has_body=has_body,
                    body=text[start + 1 : end] if has_body else "", code=code[start + 1 : end] if has_body else "")
        out.append(row)
    for m in _REGION.finditer(code):
        start = code.index("{", m.start())
        end = pairs.get(start, len(code) - 1)
        holder = next((b for b in reversed(out) if b["kind"] not in ("contract", "interface", "library") and b["has_body"] and b["start_line"] <= line(start) <= b["end_line"]), None)
        out.append(dict(kind=m["kind"], name=holder["name"] if holder else "", contract=holder["contract"] if holder else "", contract_kind=holder["contract_kind"] if holder else "",
                        is_abstract=False, bases=[], signature="", visibility="", mutability="", modifiers=[], params=[], is_virtual=False, is_override=False, start_line=line(m.start()),
                        end_line=line(end), body_line=line(start), has_body=True, body=text[start + 1 : end], code=code[start + 1 : end]))
    return out


def state_variables(text: str) -> list[dict]:
    """Variables declared directly in a contract."""
    code = blank(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for m in _DECLARED.finditer(code):
        if not m["kind"]:
            continue
        at = code.index("{", m.end()) + 1
        depth, start = 0, at
        for t in re.compile(r"[{};]").finditer(code, at):
            c = t.group()
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth < 0:
                    break
                if depth == 0:
                    start = t.end()
            elif depth == 0:
                said = code[start : t.start()]
                words = said.strip()
                v = None if _NOT_VARS.match(words) else _STATE_VAR.match(words)
                if v and v["type"] not in ("return", "delete", "new"):
                    flags = v["flags"].split()
                    out.append(dict(contract=m["name"], name=v["name"], type=re.sub(r"\s+", " ", v["type"]), visibility=next((f for f in flags if f in ("public", "private", "internal")), "internal"),
                                    is_constant="constant" in flags, is_immutable="immutable" in flags, line=bisect.bisect_left(breaks, start + len(said) - len(said.lstrip())) + 1))
                start = t.end()
    return out


_DEF = re.compile(r"^(?P<indent>[ \t]*)def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:->\s*[^:]+)?:", re.M)


def vyper_blocks(text: str) -> list[dict]:
    """Functions of a Vyper text, with their decorators as modifiers."""
    code = re.sub(r"#[^\n]*", lambda m: " " * len(m.group()), text)
    lines = text.split("\n")
    out = []
    for m in _DEF.finditer(code):
        first = code.count("\n", 0, m.start()) + 1
        last = first
        width = len(m["indent"])
        for n in range(first, len(lines)):
            if lines[n].strip() and len(lines[n]) - len(lines[n].lstrip()) <= width:
                break
            if lines[n].strip():
                last = n + 1
        marks, n = [], first - 2
        while n >= 0 and lines[n].strip().startswith("@"):
            marks.append(re.match(r"\s*@(\w+)", lines[n])[1])
            n -= 1
        params = [{"type": p.partition(":")[2].partition("=")[0].strip(), "name": p.partition(":")[0].strip()} for p in split_top(m["params"])]
        body = "\n".join(lines[first:last])
        out.append(dict(kind="constructor" if m["name"] == "__init__" else "function", name=m["name"], contract="", contract_kind="contract", is_abstract=False, bases=[],
                        signature=re.sub(r"\s+", " ", m.group()).strip(), visibility=next((d for d in ("external", "internal") if d in marks), "internal"),
                        mutability=next((d for d in ("pure", "view", "payable") if d in marks), ""), modifiers=[d for d in marks if d not in ("external", "internal", "pure", "view", "payable")],
                        params=params, is_virtual=False, is_override=False, start_line=first, end_line=last, body_line=first + 1, has_body=True, body=body, code=re.sub(r"#[^\n]*", "", body)))
    return out
