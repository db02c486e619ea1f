import re

from graphloam.operators import extract, graph_build
from graphloam.sources import tree

TS = """import { Injectable } from '@nestjs/common'
import * as store from "./store"
// class Fake {}
@Injectable()
export class CacheService<T> extends Base<T> implements Cache, Closeable {
  private readonly held: Map<string, number> = new Map()
  onHit = () => { return 1 }
  constructor(private readonly store: Store) {}

  async get(key: string, then: (a: number, b: number) => void): Promise<T> {
    if (key) { return fetch() }
    return { a: 1 }
  }
  close() { const s = `a ${b} }` }
}
export async function warm(keys: string[]): Promise<void> {
  function inner() {}
}
const arrow = () => 1
export default abstract class Base { abstract x(): void; y(): number { return 1 } }
"""
JAVA = """package a; import java.util.List; import static a.b.C.d;
@Service public abstract class Store<T> extends Base implements A, B<T> { private int n = 3; Store() {} @Override public List<String> get(int a, Map<String,Integer> m) throws E { if (a) {} return null; } abstract void z(); class In { void q() {} } }
"""
PY = """import os
from .store import Store as S
class A(Base, Mixin):
    def m(self, x, *y, k=1, **z) -> int: return 1
    class B:
        async def n(self): ...
@wrap
def top(a): ...
"""


def test_typescript():
    f = extract.facts("typescript", TS, "a.ts")
    assert [(i["source"], i["specifiers"]) for i in f["imports"]] == [("@nestjs/common", ["Injectable"]), ("./store", ["store"])]
    cache, base = f["classes"]
    assert (cache["name"], cache["extends"], cache["implements"], cache["isAbstract"]) == ("CacheService", "Base", ["Cache", "Closeable"], False)
    assert [m["name"] for m in cache["methods"]] == ["constructor", "get", "close"]
    assert cache["methods"][1]["isAsync"] and cache["methods"][1]["returnType"] == "Promise<T>" and len(cache["methods"][1]["params"]) == 2
    assert base["isAbstract"] and [m["name"] for m in base["methods"]] == ["y"]
    assert [(x["name"], x["isExported"], x["isAsync"]) for x in f["functions"]] == [("warm", True, True)]
    assert (cache["location"]["startLine"], cache["location"]["endLine"]) == (5, 15)


def test_java():
    f = extract.facts("java", JAVA, "S.java")
    assert [i["source"] for i in f["imports"]] == ["java.util.List", "a.b.C.d"]
    assert f["functions"] == [] and [c["name"] for c in f["classes"]] == ["Store", "In"]
    store = f["classes"][0]
    assert store["isAbstract"] and store["implements"] == ["A", "B"] and [m["name"] for m in store["methods"]] == ["get", "z"]
    assert store["methods"][0]["params"] == ["int a", "Map<String,Integer> m"] and store["methods"][0]["isExported"]


def test_python():
    f = extract.facts("python", PY, "p.py")
    assert [i["source"] for i in f["imports"]] == ["os", ".store"]
    assert [(c["name"], c["extends"], c["implements"], [m["name"] for m in c["methods"]]) for c in f["classes"]] == [("A", "Base", ["Mixin"], ["m"]), ("B", None, [], ["n"])]
    assert f["classes"][0]["methods"][0]["params"] == ["self", "x", "*y", "k", "**z"] and [x["name"] for x in f["functions"]] == ["top"]


def test_parse_scans_a_tree_and_survives_bad_files(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"src/cache.service.ts": TS, "src/S.java": JAVA, "bad.py": "def (", "node_modules/x.ts": "a", ".hidden.ts": "a", "README.md": "r", "deep/node_modules/y.js": "function y() {}"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "latin.js").write_bytes(b"var x = '\xff'")
    files = tree.scan_tree(spark, str(root), "r", languages_only=True)
    rows = {r["path"]: r for r in extract.parse(files).collect()}
    assert set(rows) == {"src/cache.service.ts", "src/S.java", "bad.py", "deep/node_modules/y.js", "latin.js"}
    assert rows["bad.py"]["error"].startswith("SyntaxError") and rows["latin.js"]["error"] is not None
    good = rows["src/cache.service.ts"]
    assert good["error"] is None and good["id"] == "r:src/cache.service.ts" and re.fullmatch("[0-9a-f]{64}", good["contentHash"])
    assert [h["framework"] for h in good["frameworkHints"]] == ["nestjs"] and good["metadata"]["parserVersion"] == "1.0.0"
    assert tree.scan_tree(spark, str(root), "r", any_depth=True).where("path like '%node_modules%'").count() == 0
    assert tree.languages(files).first()["languages"] == ["java", "javascript", "python", "typescript"]


def test_zip_unwraps_a_single_top_directory(spark, tmp_path):
    import zipfile

    for name, entries, expected in (("one", {"top/a.ts": "1", "top/b/c.py": "2"}, {"a.ts", "b/c.py"}), ("two", {"a.ts": "1", "top/b.py": "2"}, {"a.ts", "top/b.py"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
        assert {r["path"] for r in tree.scan_zip(spark, str(tmp_path / f"{name}.zip"), "r").collect()} == expected


def test_parsed_store_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.ts", "function f() {}", "h")], "repositoryId string, path string, content string, contentHash string")
    tree.write_parsed(extract.parse(files), str(tmp_path / "ast"), pretty_json=True)
    back = tree.read_parsed(spark, str(tmp_path / "ast"), "r", "a.ts")
    assert back.first()["functions"][0]["name"] == "f"
    assert tree.read_parsed(spark, str(tmp_path / "ast"), "r", "none.ts").count() == 0
    assert spark.read.parquet(str(tmp_path / "ast")).first()["astName"] == "a.ts.json"


REGEXES = """import a from 'a'
const tick = /`/;
const brackets = /[{/]/g, divided = 4 / 2 / 1;
export class One { m() { return /\\/[(]`/.test(x) ? 1 : 2 } }
const nested = `a ${f(`b ${ {c: `}`}.c } }`)} ${"}"} {`
export function two(x: string) { return x.replace(/'/g, "{") }
class Three { n() { return a / b } }
"""
JSX = """import React from 'react'
export default function App({ items }) {
  const less = items.length < 3
  return (
    <main className="a>b" {...rest}>
      Don't close } here
      {items.map((i) => <Row key={i.id} text={`${i.name}}`} />)}
      <></>
    </main>
  )
}
export class After extends React.Component { render() { return <p>it's {"}"}</p> } }
"""


def test_regexes_and_nested_templates():
    f = extract.facts("typescript", REGEXES, "a.ts")
    assert [c["name"] for c in f["classes"]] == ["One", "Three"] and [x["name"] for x in f["functions"]] == ["two"]
    assert [m["name"] for c in f["classes"] for m in c["methods"]] == ["m", "n"] and len(f["exports"]) == 2
    assert [(c["location"]["startLine"], c["location"]["endLine"]) for c in f["classes"]] == [(4, 4), (7, 7)]


def test_elements_in_expressions():
    f = extract.facts("typescript", JSX, "a.tsx")
    assert [(x["name"], x["location"]["startLine"], x["location"]["endLine"]) for x in f["functions"]] == [("App", 2, 11)]
    assert [(c["name"], c["extends"], [m["name"] for m in c["methods"]]) for c in f["classes"]] == [("After", "React.Component", ["render"])]
    assert [i["source"] for i in f["imports"]] == ["react"]


def test_unbalanced_files_have_an_error_and_the_facts_that_can_be_made_out(spark):
    bad = ["class A { m() {", "const a = `open ${b", "f(]", "}", "const x = <p>never closed", "import a from 'a'\nclass C { n() {} }\nfunction f() {"]
    rows = [("r", f"f{i}.tsx", t, "h") for i, t in enumerate(bad)] + [("r", "good.tsx", "class B {}", "h"), ("r", "bad.py", "def (", "h")]
    parsed = extract.parse(spark.createDataFrame(rows, "repositoryId string, path string, content string, contentHash string"))
    out = {r["path"]: r for r in parsed.collect()}
    assert all("Unbalanced" in out[f"f{i}.tsx"]["error"] for i in range(len(bad)))
    assert [c["name"] for c in out["f0.tsx"]["classes"]] == ["A"] and not out["f1.tsx"]["classes"]
    last = out["f5.tsx"]
    assert [i["source"] for i in last["imports"]] == ["a"] and [(c["name"], [m["name"] for m in c["methods"]]) for c in last["classes"]] == [("C", ["n"])] and [x["name"] for x in last["functions"]] == ["f"]
    assert out["good.tsx"]["error"] is None and out["good.tsx"]["classes"][0]["name"] == "B"
    # they are in the graph by what they have; a file that can't be parsed at all is not
    ids = {r["id"] for r in graph_build.build_graph(parsed, "r")[0].collect()}
    assert {"r:f0.tsx#A", "r:f5.tsx#C#n", "r:f5.tsx#f", "r:good.tsx"} <= ids and "r:bad.py" not in ids and "r:f1.tsx" not in ids


def seen(source: str, path: str = "a.ts") -> tuple:
    f, problem = extract.facts_and_problem("typescript", source, path)
    return [(c["name"], [m["name"] for m in c["methods"]]) for c in f["classes"]], [x["name"] for x in f["functions"]], [e["name"] for e in f["exports"]], problem


def test_a_slash_after_a_condition_begins_a_regular_expression():
    assert seen("class K { m() {} }\nfunction a(x) { if (x) /`/.test(x) }\nclass Z {}\nfunction b(x) { while (f(x)) /`/.test(x) }\n") == ([("K", ["m"]), ("Z", [])], ["a", "b"], [], None)
    assert seen("for (const k of /[\"]/g.exec(s)) /'/.exec(k)\nclass Q { static n = (1) / 2; get v() { return this.a / this.b } }\nfunction ok() {}") == ([("Q", ["v"])], ["ok"], [], None)


def test_a_slash_after_an_operand_divides():
    assert seen("let a = b++ / 2 / c, d = x! / 2, e = f() / 2, g = h[1] / `/`.length\nx.if(a) / 2 / `/`\nconst o = { a: 1 } / `/`.length\nclass T {}") == ([("T", [])], [], [], None)
    assert seen("const o = { return: /`/, of: 1 / 2 }; i = ++/`/.lastIndex\nclass T {}") == ([("T", [])], [], [], None)


def test_a_slash_after_a_block_begins_a_statement():
    assert seen("switch (x) { case 1: { a() } /'/.test(z); default: /\"/.exec(q) }\nif (a) { } else { } /`/.test(b)\nlabel: { } /`/g\ntry { } finally { } /`/.test(c)\nfunction after() {}") == ([], ["after"], [], None)
    assert seen("const f = () => { }\n/`/.test(a)\nclass W<T> extends V<T> { p = /'/; q() {} }\n/`/.test(b)\nfunction end() {}") == ([("W", ["q"])], ["end"], [], None)


def test_type_lists_are_no_elements():
    assert seen("export const f = <T extends unknown>(x: T) => x\nexport class A { m() {} }\nfunction g() { return <p>hi</p> }", "a.tsx") == ([("A", ["m"])], ["g"], ["f", "A"], None)
    assert seen("const c = <T extends { a: string }>(x: T): T => { return x }\nconst d = <const T,>(x: T) => x\nconst e = async <T, U = string>(x: T) => x\nfunction z() {}", "a.tsx") == ([], ["z"], [], None)
    assert seen("const f = <T>(x: T) => x\nfunction z() {}", "a.tsx")[1] == ["z"]  # an element by the language's rules, but none that ends
    assert seen("const a = <any>b / 2; type M = Array<Map<string, { x: number }>>\nfunction z() {}") == ([], ["z"], [], None)


def test_elements_with_types_elements_and_comments_in_attributes():
    assert seen("const e = <Foo<Map<string, () => void>> a={1} icon=<B x='>'/> /* > */ // />\n>x</Foo>\nexport function End() { return <a.b-c extends={1} /> }", "a.tsx") == ([], ["End"], ["End"], None)
