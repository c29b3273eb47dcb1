"""Scripts with markup: ranges of functions and decision points on mixed files."""

import pytest

from sparkquarry.sources.scripts import analyse

FILES = {
    "apostrophe": ("""function A() {
  return <div>it's {x && y}</div>; }
function B() { return 1 }
""", [("A", 1, 2), ("B", 3, 3)], [], [], 2),
    "list": ("""import React from 'react';
const List = ({items, on}) => (
  <>
    <ul className="a'b" onClick={() => { if (on) go(); }} {...rest}>
      {items.map(i => <li key={i.id}>{i.ok ? <b>don't</b> : `t${i.n && "x"}`} // no comment's</li>)}
      {/* it's a comment */}
      <br/> <Foo.Bar render={<p>it's</p>} data-x='1' disabled/>
    </ul>
  </>
);
class C extends React.Component { render() { return this.a ? <p>can't {this.b || 'x'}</p> : null; } }
export default function last() { return a < b && c > d; }
""", [("List", 2, 10), ("render", 11, 11), ("last", 12, 12)], [("C", 11, 11)], ["react"], 7),
    "types": ("""export const id = <T,>(x: T): T => x;
const f = <T>(x: T) => { return x ?? 1; };
const g = a < b ? c : d;
let y = <any>foo;
function h(a: Array<Map<string, number>>) { for (const q of a) { if (q.size < 3 && q.size > 1) {} } }
const tail = "</not-markup>";
""", [("id", 1, 1), ("f", 2, 2), ("h", 5, 5)], [], [], 6),
    "text": ("""function A() { return (
  <Trans>
    That's {count} item{count === 1 ? '' : 's'}, isn't it? {"{"} <b>{`a${b ? 1 : 2}`}</b>
  </Trans>
); }
function z(x) { while (x) { x--; } }
""", [("A", 1, 5), ("z", 6, 6)], [], [], 4),
    "unclosed": ("""const a = <div>never closed, isn't it;
function b() { if (a) { return '</x>'; } }
""", None, [], [], None),
    "attributes": ("""const A = () => <div style={{a: 1, b: c || 2}} />;
const B = () => <input
  value="line's
  end" onChange={e => { for (const k of e) { k ? 1 : 2; } }}
/>;
function q() { return 2; }
""", [("A", 1, 1), ("B", 2, 5), ("q", 6, 6)], [], [], 4),
}


@pytest.mark.parametrize("name", FILES)
def test_markup(name):
    code, functions, classes, imports, complexity = FILES[name]
    found = analyse(code)
    triples = lambda kind: [(x["name"], x["start_line"], x["end_line"]) for x in found[kind]]
    if functions is not None:
        assert triples("functions") == functions and found["complexity"] == complexity
    assert triples("classes") == classes and found["imports"] == imports


def test_deep_markup_is_read_in_one_pass():
    code = "const A = () => " + "<p>it's " * 150 + "{x && y}" + "</p>" * 150 + ";\nfunction b() { return 1; }\n"
    assert [(x["name"], x["start_line"]) for x in analyse(code)["functions"]] == [("A", 1), ("b", 2)] and analyse(code)["complexity"] == 2
