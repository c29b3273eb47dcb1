"""Symbols, imports and decision points of JavaScript and TypeScript, from a token scan with matched brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<number>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)n?)|(?P<name>[#@]?[^\W\d][\w$]*|[$][\w$]*)"
    r"|(?P<mark>=>|\?\?=|&&=|\|\|=|\?\?|\?\.(?!\d)|&&|\|\||\.\.\.|[-+*/%&|^=!<>]=+|\+\+|--|[{}()\[\];,.<>+\-*/%&|^!~?:=]|.)",
    re.S,
)
#: After these words a slash begins a pattern, and a brace or parenthesis an expression.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "yield", "await", "else", "do"}
CONTROL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "new", "super", "import", "require"}
#: Markup: whether a file has any, what opens and closes an element, an attribute and whether it has a value, what ends a text.
TAGS = re.compile(r"</|/>")
OPENED, CLOSED = re.compile(r"<(?:([A-Za-z_$][\w$.:-]*)|>)"), re.compile(r"</\s*([\w$.:-]*)\s*>")
ATTRIBUTE = re.compile(r"[A-Za-z_$@][\w$.:-]*(\s*=\s*)?")
BLANK, CHILD = re.compile(r"(?:\s+|/\*.*?\*/|//[^\n]*)+", re.S), re.compile(r"[<{]")
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-zA-Z]*")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    pair: int = -1


def tokens(code: str) -> list[Token]:
    """Names, numbers, strings, templates, patterns and marks; brackets know their partners. An element of markup is a template too."""
    out: list[Token] = []
    _scan(code, 0, 1, out, bool(TAGS.search(code)))
    _pair(out)
    return out


def _value_before(out: list[Token]) -> bool:
    if not out:
        return False
    last = out[-1]
    return last.kind in ("number", "string", "template", "pattern") or last.kind == "name" and last.text not in BEFORE_VALUE or last.text in (")", "]", "}")


def _scan(code: str, at: int, line: int, out: list[Token], markup: bool, inner: bool = False) -> tuple[int, int] | None:
    """Appends tokens from a place on; (place, line) of the end, which for an inner scan is the brace that closes what surrounds it.
    None if an inner scan finds no such brace."""
    depth = 0
    while at < len(code):
        if code[at] == "`":
            end, held = _template(code, at)
            out.append(Token("template", code[at:end], line))
            for start, stop in held:  # what stands in a template's braces is code too
                shift = line + code.count("\n", at, start)
                out.append(Token("mark", "(", shift))
                _scan(code[:stop], start, shift, out, markup)
                out.append(Token("mark", ")", shift + code.count("\n", start, stop)))
            line += code.count("\n", at, end)
            at = end
            continue
        if code[at] == "/" and code[at : at + 2] not in ("//", "/*") and not _value_before(out) and (m := PATTERN.match(code, at)):
            out.append(Token("pattern", m[0], line))
            at = m.end()
            continue
        if markup and code[at] == "<" and OPENED.match(code, at) and not _value_before(out):
            before = len(out)
            out.append(Token("template", "<>", line))
            if found := _element(code, at, line, out):
                at, line = found
                out.append(Token("template", "</>", line))
                continue
            del out[before:]  # a comparison or a type
        if inner and code[at] in "{}":
            depth += 1 if code[at] == "{" else -1
            if depth < 0:
                return at, line
        m = TOKEN.match(code, at)
        if m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return None if inner else (at, line)


def _braced(code: str, at: int, line: int, out: list[Token]) -> tuple[int, int] | None:
    """The code in braces within markup, in parentheses for what reads the tokens."""
    out.append(Token("mark", "(", line))
    if not (found := _scan(code, at + 1, line, out, True, True)):
        return None
    out.append(Token("mark", ")", found[1]))
    return found[0] + 1, found[1]


def _element(code: str, at: int, line: int, out: list[Token]) -> tuple[int, int] | None:
    """(place, line) after an element of markup; its text is passed over, the code in its braces is scanned. None if it isn't closed as it should be."""
    m = OPENED.match(code, at)
    name, i = m[1] or "", m.end()
    while name:  # attributes; a fragment has none
        if m := BLANK.match(code, i):
            line, i = line + m[0].count("\n"), m.end()
        if code.startswith("/>", i):
            return i + 2, line
        if code.startswith(">", i):
            i += 1
            break
        if code.startswith("{", i):
            if not (found := _braced(code, i, line, out)):
                return None
            i, line = found
            continue
        if not (m := ATTRIBUTE.match(code, i)):
            return None
        line, i = line + m[0].count("\n"), m.end()
        if not m[1]:
            continue
        if code.startswith("{", i):
            found = _braced(code, i, line, out)
        elif code[i : i + 1] in ("'", '"') and (end := code.find(code[i], i + 1)) > 0:
            found = end + 1, line + code.count("\n", i, end)
        else:
            found = _element(code, i, line, out) if OPENED.match(code, i) else None
        if not found:
            return None
        i, line = found
    while m := CHILD.search(code, i):
        line, i = line + code.count("\n", i, m.start()), m.start()
        if code[i] == "{":
            found = _braced(code, i, line, out)
        elif m := CLOSED.match(code, i):
            return (m.end(), line + m[0].count("\n")) if m[1] == name else None
        else:
            found = _element(code, i, line, out) if OPENED.match(code, i) else None
        if not found:
            return None
        i, line = found
    return None


def _template(code: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Where a template ends, and its embedded expressions."""
    inner, i = [], at + 1
    while i < len(code):
        if code[i] == "\\":
            i += 2
        elif code[i] == "`":
            return i + 1, inner
        elif code.startswith("${", i):
            start, depth, i = i + 2, 1, i + 2
            while i < len(code) and depth:
                if code[i] == "`":
                    i = _template(code, i)[0]
                    continue
                depth += {"{": 1, "}": -1}.get(code[i], 0)
                i += 1
            inner.append((start, i - 1))
        else:
            i += 1
    return len(code), inner


def _pair(found: list[Token]) -> None:
    opened: list[int] = []
    for i, t in enumerate(found):
        if t.kind != "mark":
            continue
        if t.text in "([{" and t.text:
            opened.append(i)
        elif t.text in (")", "]", "}"):
            want = {")": "(", "]": "[", "}": "{"}[t.text]
            while opened and found[opened[-1]].text != want:
                opened.pop()
            if opened:
                j = opened.pop()
                t.pair, found[j].pair = j, i
    for i in opened:
        found[i].pair = len(found) - 1


def analyse(code: str) -> dict:
    """{classes, functions, imports, complexity}; symbols in the order in which they begin.

    Arrow functions and anonymous function expressions are named by the variable they are assigned to in its declaration;
    without one they are left out. Classes without a name are AnonymousClass."""
    t = tokens(code)
    n = len(t)
    classes, functions, imports = [], [], set()
    text = [x.text if x.kind in ("mark", "name") else "" for x in t]
    text.append("")

    def declared(i: int) -> str:
        """The variable whose declaration the value that begins at token i completes."""
        k = i - 1
        while k >= 0 and text[k] == "async":
            k -= 1
        if k < 1 or text[k] != "=":
            return ""
        k -= 1
        if t[k].kind == "name" and k >= 1 and text[k - 1] in ("const", "let", "var", ","):
            return text[k]
        while k >= 1 and text[k] != ":":  # a type stands between the name and its value
            if text[k] in (";", "{", "}", "=") and t[k].pair < 0:
                return ""
            k = t[k].pair if text[k] in (")", "]", "}") and t[k].pair >= 0 else k - 1
        if k >= 2 and t[k - 1].kind == "name" and text[k - 2] in ("const", "let", "var", ","):
            return text[k - 1]
        return ""

    def body_after(i: int) -> int:
        """The brace that opens a body after a parameter list's end, past a return type; -1 if there is none."""
        k = i
        while k < n and text[k] not in ("{", ";"):
            if text[k] in (",", ")", "]", "}", "=>", "="):
                return -1
            k = t[k].pair + 1 if text[k] in ("(", "[") and t[k].pair > k else k + 1
        if k < n and text[k] == "{" and i < k and text[k - 1] in (":", "|", "&") and t[k].pair > k:  # an object type
            return body_after(t[k].pair + 1)
        return k if k < n and text[k] == "{" else -1

    def statement_end(i: int) -> int:
        """The last token of an expression that begins at i."""
        k = i
        while k < n and text[k] not in (",", ";", ")", "]", "}"):
            if text[k] in ("(", "[", "{") and t[k].pair > k:
                k = t[k].pair
            elif k > i and t[k].line > t[k - 1].line and t[k].kind == "name" and (t[k - 1].kind != "mark" or text[k - 1] in (")", "]", "}")):
                break
            k += 1
        return max(i, k - 1)

    bodies: set[int] = set()  # braces whose direct members may be methods
    objects: set[int] = set()
    complexity = 1
    for i, x in enumerate(t):
        if x.kind == "mark":
            if x.text in ("&&", "||", "??"):
                complexity += 1
            elif x.text == "?" and text[i + 1] not in (":", ")", ",", "=", "}", "]", ";") and _is_ternary(t, text, i):
                complexity += 1
            elif x.text == "{" and i and (text[i - 1] in ("(", "[", ",", "=", ":", "?", "=>", "&&", "||", "??") or text[i - 1] in ("return",)) and text[i - 1] != "=>":
                objects.add(i)
            elif x.text == "=>":
                start = _arrow_start(t, text, i)
                if name := declared(start):
                    last = t[i + 1].pair if i + 1 < n and text[i + 1] == "{" and t[i + 1].pair > i else statement_end(i + 1) if i + 1 < n else i
                    functions.append((start, name, t[_async(text, start)].line, t[last].line))
            continue
        if x.kind != "name":
            continue
        member = i > 0 and text[i - 1] in (".", "?.")
        inside = _enclosing(t, text, i)
        key = text[i + 1] == ":" and inside in objects
        if member or key:
            continue
        if x.text in ("if", "for", "while", "catch") and (text[i + 1] in ("(", "await", "{")) and not (inside in bodies and text[i + 1] == "(" and _is_method(t, text, i, inside)):
            if not (x.text == "while" and _closes_do(t, text, i)):
                complexity += 1
        elif x.text == "do" and text[i + 1] == "{":
            complexity += 1
        elif x.text == "case" and inside not in objects:
            complexity += 1
        elif x.text == "class" and (t[i + 1].kind == "name" if i + 1 < n else False or text[i + 1] == "{"):
            name = text[i + 1] if t[i + 1].kind == "name" and text[i + 1] not in ("extends", "implements") else "AnonymousClass"
            k = i + 1
            while k < n and text[k] != "{":
                k = t[k].pair + 1 if text[k] in ("(", "[") and t[k].pair > k else k + 1
            if k < n:
                bodies.add(k)
                classes.append((i, name, x.line, t[t[k].pair].line))
        elif x.text == "class" and text[i + 1] == "{":
            bodies.add(i + 1)
            classes.append((i, "AnonymousClass", x.line, t[t[i + 1].pair].line))
        elif x.text == "function" and text[i + 1] != "*":
            name = text[i + 1] if i + 1 < n and t[i + 1].kind == "name" else ""
            k = i + 1 + bool(name)
            k = _past_types(t, text, k)
            if k < n and text[k] == "(" and t[k].pair > k:
                body = body_after(t[k].pair + 1)
                if body >= 0 and (name := name or declared(i)):
                    functions.append((i, name, t[_async(text, i)].line, t[t[body].pair].line))
        elif inside in bodies | objects and x.text not in CONTROL and _is_method(t, text, i, inside):
            k = _past_types(t, text, i + 1)
            body = body_after(t[k].pair + 1)
            if body >= 0:
                functions.append((i, x.text.lstrip("@"), t[_modifiers(t, text, i, inside)].line, t[t[body].pair].line))
        elif x.text == "import":
            if text[i + 1] == "(":
                if i + 2 < n and t[i + 2].kind == "string":
                    imports.add(_bare(t[i + 2].text))
            elif i + 1 < n and t[i + 1].kind == "string":
                imports.add(_bare(t[i + 1].text))
            else:
                k = i + 1
                while k < n and text[k] != ";" and not (text[k] == "from" and k + 1 < n and t[k + 1].kind == "string") and text[k] != "=":
                    k = t[k].pair + 1 if text[k] == "{" and t[k].pair > k else k + 1
                if k < n and text[k] == "from":
                    imports.add(_bare(t[k + 1].text))
        elif x.text == "require" and text[i + 1] == "(" and i + 2 < n and t[i + 2].kind == "string":
            imports.add(_bare(t[i + 2].text))
    order = lambda found: [{"name": a, "start_line": s, "end_line": e} for _, a, s, e in sorted(found)]
    return {"classes": order(classes), "functions": order(functions), "imports": sorted(imports), "complexity": complexity}


def _bare(text: str) -> str:
    return text.strip("\"'")


def _enclosing(t: list[Token], text: list[str], i: int) -> int:
    """The open bracket around token i, or -1."""
    k = i - 1
    while k >= 0:
        if text[k] in (")", "]", "}") and 0 <= t[k].pair < k:
            k = t[k].pair - 1
        elif text[k] in ("(", "[", "{"):
            return k
        else:
            k -= 1
    return -1


def _past_types(t: list[Token], text: list[str], k: int) -> int:
    """Past type parameters in angle brackets."""
    if text[k] != "<":
        return k
    depth = 0
    while k < len(t):
        depth += {"<": 1, ">": -1}.get(text[k], 0)
        k += 1
        if not depth:
            break
    return k


def _is_method(t: list[Token], text: list[str], i: int, inside: int) -> bool:
    """A name with a parameter list and a body, at the head of a member."""
    k = _past_types(t, text, i + 1)
    if not (k < len(t) and text[k] == "(" and t[k].pair > k):
        return False
    after = t[k].pair + 1
    if after >= len(t) or text[after] not in ("{", ":"):
        return False
    p = _modifiers(t, text, i, inside) - 1
    return p <= inside or text[p] in ("}", ";", ",", "{") or t[p].line < t[i].line or t[p].kind == "string"


def _modifiers(t: list[Token], text: list[str], i: int, inside: int) -> int:
    k = i
    while k - 1 > inside and text[k - 1] in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*"):
        k -= 1
    return k


def _async(text: list[str], i: int) -> int:
    return i - 1 if i and text[i - 1] == "async" else i


def _arrow_start(t: list[Token], text: list[str], i: int) -> int:
    """The first token of an arrow function's parameters, before a return type if there is one."""
    k = i - 1
    if k >= 0 and text[k] == ")" and t[k].pair >= 0:
        k = t[k].pair
    else:
        back = k
        while back >= 0 and text[back] not in ("=", "(", ",", ";", "{", "}"):
            if text[back] == ")" and t[back].pair >= 0:
                k = t[back].pair
                break
            back -= 1
    if k >= 1 and text[k - 1] == ">":
        depth = 0
        while k >= 1:
            k -= 1
            depth += {">": 1, "<": -1}.get(text[k], 0)
            if not depth:
                break
    return max(k, 0)


def _closes_do(t: list[Token], text: list[str], i: int) -> bool:
    return i > 0 and text[i - 1] == "}" and t[i - 1].pair > 0 and text[t[i - 1].pair - 1] == "do"


def _is_ternary(t: list[Token], text: list[str], i: int) -> bool:
    """Whether a question mark has its colon, at its own depth, before its expression ends."""
    depth, k = 0, i + 1
    while k < len(t):
        if text[k] in ("(", "[", "{") and t[k].pair > k:
            k = t[k].pair + 1
            continue
        if text[k] in (")", "]", "}", ";"):
            return False
        if text[k] == "?" and text[k + 1] not in (":", ")", ",", "="):
            depth += 1
        elif text[k] == ":":
            if not depth:
                return True
            depth -= 1
        k += 1
    return False
