"""CSS and XPath selectors over one page's nodes (E5).

A page is a list of nodes in document order with interval labels: a node's
descendants are exactly those between its ``pos`` and its ``end``.  A selector is
compiled once to steps; a step goes through the nodes once and keeps, on the way,
what the matches of the step before allow: the furthest end of any match so far
(descendants), the matches' positions (children), the sibling just before, or
that a sibling before matched.  So a selector of k steps costs k passes over the
page, whatever its nesting.

CSS: type, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]`` and ``~= |= ^= $= *=``,
``:not(...)``, ``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child(an+b)``,
``:nth-of-type``, ``:first-of-type``, ``:last-of-type``, ``:empty``; descendant, ``>``,
``+``, ``~`` and comma lists.  XPath: ``/``, ``//``, names, ``*``, ``text()`` as last
step, and at any step predicates of positions, ``@a``, ``text()``, ``.``, ``=``, ``!=``,
``contains``, ``starts-with``, ``not``, ``and``, ``or``.  Anything else raises ``ValueError``.
"""

from __future__ import annotations

import re
from typing import Callable

SELECTOR_TYPES = ("css", "xpath")

_NAME = r"-?[A-Za-z_][A-Za-z0-9_-]*"
_CSS_TOKEN = re.compile(
    rf"""(?P<space>\s*(?P<comb>[>+~,])\s*|\s+)|(?P<tag>\*|{_NAME})|\#(?P<id>[A-Za-z0-9_-]+)|\.(?P<class>[A-Za-z0-9_-]+)
    |\[\s*(?P<attr>[A-Za-z_:][A-Za-z0-9_:.-]*)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""", re.X)
_XPATH_TOKEN = re.compile(
    r"""\s*(?:(?P<axis>//|/)|(?P<number>\d+)|(?P<text>"[^"]*"|'[^']*')|(?P<attr>@[A-Za-z_:][A-Za-z0-9_:.-]*)|(?P<op>!=|=|<=|>=|<|>)
    |(?P<name>\*|[A-Za-z_][A-Za-z0-9_.-]*(?:\(\))?)|(?P<punct>[\[\](),.]))""", re.X)


class Page:
    """Elements of a page in document order, with what sibling and position tests need."""

    def __init__(self, nodes: list[dict]):
        self.nodes = nodes
        self.elements = [n for n in nodes if n["kind"] == "e"]
        self.children: dict[int, list[dict]] = {}
        self.texts: dict[int, list[str]] = {}
        self.index: dict[int, int] = {}
        for n in nodes:
            if n["kind"] == "e":
                siblings = self.children.setdefault(n["parent"], [])
                self.index[n["pos"]] = len(siblings)
                siblings.append(n)
            elif n["kind"] == "t":
                self.texts.setdefault(n["parent"], []).append(n["text"])

    def siblings(self, n: dict, same_tag: bool = False) -> list[dict]:
        all_of = self.children[n["parent"]]
        return [s for s in all_of if s["tag"] == n["tag"]] if same_tag else all_of

    def inner_text(self, n: dict) -> str:
        first = next((i for i, x in enumerate(self.nodes) if x["pos"] >= n["pos"]), 0)
        out = []
        for x in self.nodes[first:]:
            if x["pos"] > n["end"]:
                break
            if x["kind"] == "t":
                out.append(x["text"])
        return "".join(out)


Test = Callable[[Page, dict], bool]


# --- CSS ------------------------------------------------------------------------

def _nth(arg: str) -> Callable[[int], bool]:
    text = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise ValueError("unsupported position: %r" % arg)
    a = 0 if m.group(1) is None else int(m.group(1) + "1") if m.group(1) in ("", "+", "-") else int(m.group(1))
    b = int(m.group(2) or 0)
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _at(page: Page, n: dict) -> int:
    return page.index[n["pos"]] + 1


def _at_of_type(page: Page, n: dict) -> int:
    return next(i for i, s in enumerate(page.siblings(n, True), 1) if s is n)


def _pseudo(name: str, arg: str | None) -> Test:
    if name in ("nth-child", "nth-of-type") and arg is not None:
        place, of = _nth(arg), _at if name == "nth-child" else _at_of_type
        return lambda page, n: place(of(page, n))
    if name == "not" and arg:
        inner = [_compound(part) for part in _split_list(arg)]
        return lambda page, n: not any(all(t(page, n) for t in tests) for tests in inner)
    simple: dict[str, Test] = {
        "first-child": lambda page, n: page.siblings(n)[0] is n,
        "last-child": lambda page, n: page.siblings(n)[-1] is n,
        "only-child": lambda page, n: len(page.siblings(n)) == 1,
        "first-of-type": lambda page, n: page.siblings(n, True)[0] is n,
        "last-of-type": lambda page, n: page.siblings(n, True)[-1] is n,
        "empty": lambda page, n: n["pos"] not in page.children and not any(page.texts.get(n["pos"], ())),
    }
    if name in simple and arg is None:
        return simple[name]
    raise ValueError("unsupported pseudo-class: %r" % name)


def _attribute(name: str, op: str | None, value: str) -> Test:
    name = name.lower()
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda x: True, "=": lambda x: x == value, "~=": lambda x: value in x.split(),
        "|=": lambda x: x == value or x.startswith(value + "-"), "^=": lambda x: value != "" and x.startswith(value),
        "$=": lambda x: value != "" and x.endswith(value), "*=": lambda x: value != "" and value in x}
    test = tests[op]
    return lambda page, n: name in n["attrs"] and test(n["attrs"][name])


def _css_tokens(text: str) -> list[re.Match]:
    out, at = [], 0
    while at < len(text):
        m = _CSS_TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError("unsupported CSS selector: %r" % text)
        out.append(m)
        at = m.end()
    return out


def _tag_test(tag: str) -> Test:
    return lambda page, n: n["tag"] == tag


def _one(m: re.Match) -> Test:
    if m.group("tag"):
        return (lambda page, n: True) if m.group("tag") == "*" else _tag_test(m.group("tag").lower())
    if m.group("id"):
        return _attribute("id", "=", m.group("id"))
    if m.group("class"):
        return _attribute("class", "~=", m.group("class"))
    if m.group("attr"):
        value = next((m.group(g) for g in ("dq", "sq", "bare") if m.group(g) is not None), "")
        return _attribute(m.group("attr"), m.group("op"), value)
    return _pseudo(m.group("pseudo"), m.group("arg"))


def _compound(text: str) -> list[Test]:
    tokens = _css_tokens(text.strip())
    if not tokens or any(m.group("space") is not None or (m.group("tag") and i) for i, m in enumerate(tokens)):
        raise ValueError("unsupported CSS selector: %r" % text)
    return [_one(m) for m in tokens]


def _split_list(text: str) -> list[str]:
    """The parts of a comma list; commas in brackets, parentheses and quotes are part of one."""
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


def _css_steps(text: str) -> list[tuple[str, list[Test]]]:
    steps: list[tuple[str, list[Test]]] = []
    axis, start, text = " ", 0, text.strip()
    for m in [*_css_tokens(text), None]:
        if m is None or m.group("space") is not None:
            steps.append((axis, _compound(text[start:m.start() if m else len(text)])))
            if m:
                axis, start = m.group("comb") or " ", m.end()
    return steps


# --- XPath ----------------------------------------------------------------------

class _XPath:
    """Recursive descent over the tokens of one path; predicates become tests of (page, node, position)."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _XPATH_TOKEN.match(text, at)
            if not m:
                raise self.error()
            kind = m.lastgroup
            self.tokens.append((kind, m.group(kind)))
            at = m.end()
        self.at = 0

    def error(self) -> ValueError:
        return ValueError("unsupported XPath: %r" % self.text)

    def peek(self, value: str | None = None):
        token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return token if value is None else token[1] == value

    def take(self, value: str | None = None):
        token = self.peek()
        if token[0] is None or (value is not None and token[1] != value):
            raise self.error()
        self.at += 1
        return token

    def path(self) -> tuple[list[tuple[str, list, list]], bool]:
        """Steps ``(axis, tests, predicates)`` and whether the last step asks for text."""
        steps, as_text = [], False
        while self.peek()[0] == "axis":
            if as_text:
                raise self.error()
            axis = self.take()[1]
            kind, name = self.take()
            if kind != "name" or (name.endswith("()") and name != "text()"):
                raise self.error()
            as_text = name == "text()"
            tests = [] if name in ("*", "text()") else [_tag_test(name.lower())]
            predicates = []
            while self.peek("["):
                self.take()
                if self.peek()[0] == "number" and self.tokens[self.at + 1:self.at + 2] == [("punct", "]")]:
                    number = int(self.take()[1])
                    predicates.append(lambda page, n, i, number=number: i == number)
                else:
                    predicates.append(self.either())
                self.take("]")
            if as_text and predicates:
                raise self.error()
            steps.append(("text" if as_text else axis, tests, predicates))
        if not steps or self.at < len(self.tokens):
            raise self.error()
        return steps, as_text

    def either(self):
        tests = [self.both()]
        while self.peek("or"):
            self.take()
            tests.append(self.both())
        return tests[0] if len(tests) == 1 else lambda page, n, i: any(t(page, n, i) for t in tests)

    def both(self):
        tests = [self.single()]
        while self.peek("and"):
            self.take()
            tests.append(self.single())
        return tests[0] if len(tests) == 1 else lambda page, n, i: all(t(page, n, i) for t in tests)

    def single(self):
        kind, value = self.peek()
        if value == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if value in ("not", "contains", "starts-with"):
            self.take()
            self.take("(")
            if value == "not":
                inner = self.either()
                self.take(")")
                return lambda page, n, i: not inner(page, n, i)
            of = self.values()
            self.take(",")
            kind, text = self.take()
            self.take(")")
            if kind != "text":
                raise self.error()
            part = text[1:-1]
            # a function of a node set looks at its first node
            test = (lambda x: part in x) if value == "contains" else (lambda x: x.startswith(part))
            return lambda page, n, i: test((of(page, n) or [""])[0])
        if value == "position()":
            self.take()
            op, number = self.take()[1], int(self.take()[1])
            compare = {"=": int.__eq__, "!=": int.__ne__, "<": int.__lt__, ">": int.__gt__, "<=": int.__le__, ">=": int.__ge__}[op]
            return lambda page, n, i: compare(i, number)
        of = self.values()
        if self.peek()[1] in ("=", "!="):
            op = self.take()[1]
            kind, text = self.take()
            if kind not in ("text", "number"):
                raise self.error()
            wanted = text[1:-1] if kind == "text" else text
            # true if any node of the set compares so
            return (lambda page, n, i: wanted in of(page, n)) if op == "=" else (lambda page, n, i: any(x != wanted for x in of(page, n)))
        return lambda page, n, i: bool(of(page, n))

    def values(self):
        """A node set as its strings: an attribute, the node's texts, all text inside it, or the text of children."""
        kind, value = self.take()
        if kind == "attr":
            name = value[1:].lower()
            return lambda page, n: [n["attrs"][name]] if name in n["attrs"] else []
        if value == "text()":
            return lambda page, n: page.texts.get(n["pos"], [])
        if value == ".":
            return lambda page, n: [page.inner_text(n)]
        if kind == "name" and not value.endswith("()") and value not in ("and", "or", "last"):
            return lambda page, n: [page.inner_text(c) for c in page.children.get(n["pos"], []) if value in ("*", c["tag"])]
        raise self.error()


# --- matching -------------------------------------------------------------------

def _reachable(page: Page, axis: str, context: list[dict] | None) -> list[dict]:
    """Elements that the axis leads to from the context (None: the document), in document order."""
    if context is None:
        return page.elements if axis in (" ", "//") else page.children.get(0, [])
    at = {n["pos"] for n in context}
    out: list[dict] = []
    if axis in (" ", "//"):
        inside, todo = 0, iter(sorted((n["pos"], n["end"]) for n in context))
        following = next(todo, None)
        for n in page.elements:
            while following is not None and following[0] < n["pos"]:
                inside, following = max(inside, following[1]), next(todo, None)
            if n["pos"] <= inside:
                out.append(n)
    elif axis in (">", "/"):
        out = [n for n in page.elements if n["parent"] in at]
    else:
        met: dict[int, bool] = {}
        for n in page.elements:
            if met.get(n["parent"]):
                out.append(n)
            here = n["pos"] in at
            met[n["parent"]] = here or (axis == "~" and met.get(n["parent"], False))
    return out


def _css_matches(page: Page, steps: list) -> list[dict]:
    context = None
    for axis, tests in steps:
        context = [n for n in _reachable(page, axis, context) if all(t(page, n) for t in tests)]
    return context or []


def _xpath_matches(page: Page, steps: list) -> list[dict]:
    context = None
    for axis, tests, predicates in steps:
        if axis == "text":
            break
        found = [n for n in _reachable(page, axis, context) if all(t(page, n) for t in tests)]
        for test in predicates:
            # positions count among what is left of one parent's children
            seen: dict[int, int] = {}
            kept = []
            for n in found:
                seen[n["parent"]] = seen.get(n["parent"], 0) + 1
                if test(page, n, seen[n["parent"]]):
                    kept.append(n)
            found = kept
        context = found
    return context or []


def compile_selector(selector: str, selector_type: str = "css") -> Callable[[list[dict]], str]:
    """The selector as a function of a page's nodes: for each match in document order the texts of the elements
    in its subtree (each one's text before its first child) joined by a space, and a space; a match without text adds nothing."""
    if selector_type not in SELECTOR_TYPES:
        raise ValueError("selector_type must be css or xpath")
    if not selector or not selector.strip():
        raise ValueError("selector must not be blank")
    if selector_type == "css":
        lists, as_text = [_css_steps(part) for part in _split_list(selector)], False
    else:
        steps, as_text = _XPath(selector.strip()).path()

    def content(nodes: list[dict]) -> str:
        page = Page(nodes)
        if selector_type == "css":
            found = {n["pos"]: n for steps_of in lists for n in _css_matches(page, steps_of)}
            matches = [found[p] for p in sorted(found)]
        else:
            matches = _xpath_matches(page, steps)
        if as_text:
            owners = matches if len(steps) > 1 else page.elements
            return "".join(t + " " for n in owners for t in page.texts.get(n["pos"], []) if t)
        own = [n for n in nodes if n["kind"] in ("e", "c") and n["text"]]
        out, start = [], 0
        for n in matches:
            while start < len(own) and own[start]["pos"] < n["pos"]:
                start += 1
            end = start
            while end < len(own) and own[end]["pos"] <= n["end"]:
                end += 1
            if end > start:
                out.append(" ".join(x["text"] for x in own[start:end]) + " ")
        return "".join(out)

    return content
