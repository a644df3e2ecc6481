"""Facts of a small TypeScript project, and where its files come from."""

import os
import subprocess

import pytest

from lattica.operators import cycles
from lattica.plans import queries as q
from lattica.sources import commits, scan, typescript

PROJECT = {
    "main.ts": """import { start } from './api/index';
import type { Options } from "./types";
import * as text from './util/text.js';

/* entry */
export function main(o: Options): void {
  const server = start(o);
  if (o.port && o.host) { text.shout(`at ${text.trim(o.host)}`); }
  new Missing();
}
main({ port: 1 } as Options);
""",
    "types.ts": "export interface Options { port: number; host?: string }\nexport type Mode = 'a' | 'b';\nexport enum Level { Low, High }\n",
    "api/index.ts": "export { start } from './server';\nexport * from './routes';\nexport * as helpers from '../util/text';\n",
    "api/server.ts": """import { Database } from '../db/database';
import { route as addRoute } from './routes';
import type { Options } from '../types';

class Server {
  private db: Database;
  constructor(private readonly options: Options) {
    this.db = new Database(options.host ?? 'x');
    this.db.connect();
  }
  async listen(): Promise<{ ok: boolean }> {
    addRoute('/');
    for (const r of await this.db.query('q')) { this.log(r); }
    return { ok: true };
  }
  private log(x: unknown) { console.log(x); }
}

export const start = async (o: Options): Promise<Server> => {
  const s = new Server(o);
  await s.listen();
  return s;
};
export const LIMIT = 10;
export default Server;
""",
    "api/routes.ts": "import { start } from './server';\nexport function route(path: string) { return path ? start : /a[/]b/.test(path) || null; }\nexport let count = 0, other = 1;\n",
    "db/database.ts": """export class Database {
  static open(): Database { return new Database(''); }
  constructor(public name: string) {}
  connect() { retry(() => this.query('1')); }
  query<T>(sql: string): T[] { switch (sql) { case 'a': return []; default: return []; } }
}
function retry(f: () => void) { try { f(); } catch (e) { do { f(); } while (false); } }
""",
    "util/text.ts": "export const trim = (x: string) => x.trim();\nexport function shout(x: string): string {\n  return trim(x).toUpperCase();\n}\n",
    "util/text.test.ts": "import { shout } from './text';\nimport { fake } from '@lib/fake';\nimport fs from 'fs';\nshout('x');\nfake();\n",
    "lib/fake.tsx": "export default function fakeDefault() {}\nexport const fake = function () { return 1; };\n",
    "db/tests/any.spec.ts": "",
    "gen/out.ts": "export const x = 1;\n",
    "node_modules/m/i.ts": "export const m = 1;\n",
    "types.d.ts": "declare const z: number;\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("project")
    for path, text in PROJECT.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    (base / ".gitignore").write_text("# built\ngen/\n*.js\n")
    (base / "tsconfig.json").write_text('{ // paths\n "compilerOptions": { "paths": { "@lib/*": ["lib/*"], } } }')
    os.symlink(base, base / "util" / "loop")
    os.symlink(base / "nowhere.ts", base / "broken.ts")
    return str(base)


@pytest.fixture(scope="module")
def graph(spark, root):
    return typescript.source_graph(scan.read_sources(spark, root), aliases=scan.path_aliases(root)).pinned()


def test_scan(root, tmp_path, spark):
    assert sorted(scan.source_paths(root)) == sorted(p for p in PROJECT if not p.startswith(("gen/", "node_modules/")) and not p.endswith(".d.ts"))
    assert scan.path_aliases(root) == [("@lib/", "lib/")] and scan.path_aliases(str(tmp_path)) == []
    with pytest.raises(ValueError):
        scan.read_sources(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        scan.read_sources(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("text, loc", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\n\n", 2), ("// x\n// y\n// z\n", 3)])
def test_loc(text, loc):
    assert typescript._File(text).loc == loc


def test_exports(graph):
    got = {(r["file"], r["name"]): r for r in graph.exports.collect()}
    kinds = {k: r["kind"] for k, r in got.items()}
    assert kinds["main.ts", "main"] == "function" and kinds["types.ts", "Options"] == "interface" and kinds["types.ts", "Mode"] == "type" and kinds["types.ts", "Level"] == "enum"
    assert kinds["api/server.ts", "start"] == "function" and kinds["api/server.ts", "LIMIT"] == "variable" and kinds["api/server.ts", "default"] == "class"
    assert got["api/server.ts", "default"]["is_default"] and kinds["lib/fake.tsx", "default"] == kinds["lib/fake.tsx", "fake"] == "function"
    # re-exports: of the kind declared elsewhere, one line, no complexity
    again = got["api/index.ts", "start"]
    assert (again["kind"], again["loc"], again["complexity"]) == ("function", 1, 0)
    assert {n for f, n in got if f == "api/index.ts"} >= {"start", "route", "count", "other"}
    assert got["main.ts", "main"]["complexity"] == 3 and got["main.ts", "main"]["loc"] == 5
    assert got["api/routes.ts", "route"]["complexity"] == 3
    assert got["db/database.ts", "Database"]["complexity"] == 2 and got["util/text.ts", "shout"]["loc"] == 3


def test_imports_and_edges(graph):
    got = {(r["source"], r["target"]): r for r in graph.edges.collect()}
    assert got["main.ts", "types.ts"]["is_type_only"] and got["main.ts", "util/text.ts"]["symbols"] == ["* as text"]
    assert got["api/server.ts", "api/routes.ts"]["symbols"] == ["addRoute"] and got["api/index.ts", "api/routes.ts"]["symbols"] == ["*"]
    assert got["api/index.ts", "util/text.ts"]["symbols"] == [] and got["util/text.test.ts", "lib/fake.tsx"]["symbols"] == ["fake"]
    assert got["db/tests/any.spec.ts", "db/database.ts"]["symbols"] == ["tests"] and len(got) == 13


def test_calls(graph):
    got = {(r["source"], r["target"]) for r in graph.call_edges.collect()}
    assert got == {
        ("main.ts::<module>", "main.ts::main"), ("main.ts::main", "api/server.ts::start"), ("main.ts::main", "util/text.ts::shout"), ("main.ts::main", "util/text.ts::trim"),
        ("api/server.ts::Server.constructor", "db/database.ts::Database.connect"), ("api/server.ts::Server.listen", "api/routes.ts::route"), ("api/server.ts::Server.listen", "db/database.ts::Database.query"),
        ("api/server.ts::Server.listen", "api/server.ts::Server.log"), ("api/server.ts::start", "api/server.ts::Server.listen"), ("db/database.ts::Database.connect", "db/database.ts::retry"),
        ("db/database.ts::Database.connect", "db/database.ts::Database.query"), ("util/text.ts::shout", "util/text.ts::trim"), ("util/text.test.ts::<module>", "util/text.ts::shout"), ("util/text.test.ts::<module>", "lib/fake.tsx::fake"),
    }


def test_test_files(graph):
    got = {r["path"]: r for r in graph.files.collect()}
    assert got["util/text.ts"]["test_file"] == "util/text.test.ts" and got["db/database.ts"]["test_file"] == "db/tests/any.spec.ts"
    assert got["main.ts"]["test_file"] is None and got["util/text.test.ts"]["is_test"] and got["db/tests/any.spec.ts"]["loc"] == 0


def test_queries_over_a_project(graph):
    a = q.Analysis(graph)
    assert ["api/server.ts", "api/routes.ts", "api/server.ts"] in [r["cycle"] for r in cycles.circular_dependencies(graph.files, graph.edges).collect()]
    dead = {r["path"]: r["dead_exports"] for r in q.dead_exports(a)["files"].collect()}
    assert "LIMIT" in dead["api/server.ts"] and "start" not in dead["api/server.ts"]
    assert {r["symbol"] for r in q.impact(a, "Database.query").collect()} >= {"Server.listen", "start", "main"}


def test_git(spark, tmp_path):
    run = lambda *x: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *x], check=True, capture_output=True)
    assert commits.head(str(tmp_path)) == "unknown" and commits.touched(spark, str(tmp_path)).count() == 0
    with pytest.raises(RuntimeError):
        commits.changed(spark, str(tmp_path / "none"))
    run("init", "-q")
    for text in ("1", "2"):
        (tmp_path / "a.ts").write_text(text)
        run("add", "-A")
        run("commit", "-qm", text)
    (tmp_path / "a.ts").write_text("3")
    assert [tuple(r) for r in commits.churn(commits.touched(spark, str(tmp_path))).collect()] == [("a.ts", 2)]
    assert commits.changed(spark, str(tmp_path), "unstaged").count() == 1 and commits.changed(spark, str(tmp_path), "staged").count() == 0
    assert len(commits.head(str(tmp_path))) == 40


def test_cli(spark, root, capsys):
    import json

    from lattica import cli

    assert cli.main(["status", root], spark) == 1
    assert cli.main(["hotspots", root, "--metric", "fan_in", "--limit", "1", "--json"], spark) == 0
    out = capsys.readouterr().out
    shown = json.loads(out[out.index("{") :])
    assert shown["hotspots"][0]["path"] in ("api/server.ts", "util/text.ts") and shown["next_steps"]
    assert cli.main(["file", root, "src/main.ts"], spark) == 0 and "types.ts" in capsys.readouterr().out
    assert cli.main(["file", root, "maine.ts"], spark) == 1 and "main.ts" in capsys.readouterr().err
    assert cli.main(["status", root], spark) == 0
    for wrong in (["hotspots", root, "--limit", "0"], ["hotspots", root, "--metric", "x"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong, spark)
        assert e.value.code == 2
    assert cli.main(["clean", root], spark) == 0 and cli.main(["status", root], spark) == 1


def test_store_is_reused_for_the_same_head_only(spark, graph, tmp_path):
    from lattica.sources import store

    folder = str(tmp_path / "saved")
    assert store.load(spark, folder) is None
    store.save(graph, folder, "abc")
    assert store.usable(spark, folder, "abc").edges.count() == graph.edges.count()
    assert store.usable(spark, folder, "abd") is None and store.usable(spark, folder, "abc", True) is None and store.usable(spark, folder, "unknown") is None


def test_server(spark, root, graph):
    import json

    from lattica import server

    a, out = q.Analysis(graph), []
    ask = [
        {"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "find_hotspots", "arguments": {"metric": "fan_in"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "symbol_context", "arguments": {"name": "nobody"}}}, {"id": 5, "method": "nonsense"}, {"id": 6, "method": "resources/read", "params": {"uri": "codebase://processes"}}, {"id": 7, "method": "prompts/list"},
    ]
    server.serve(a, spark, root, [json.dumps(x) for x in ask] + ["{"], out.append)
    got = [json.loads(x) for x in out]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, 7, None] and len(got[1]["result"]["tools"]) == 15
    assert json.loads(got[2]["result"]["content"][0]["text"])["nextSteps"] == ["file", "forces"]
    assert got[3]["result"]["isError"] and "error" in got[4] and "main" in got[5]["result"]["contents"][0]["text"]


def test_streaming_churn(spark, tmp_path):
    from datetime import datetime

    from lattica.streaming.churn import windowed_churn

    rows = [(datetime(2024, 1, d, 5), f) for d, f in [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (5, "z")]]
    spark.createDataFrame(rows, "ts timestamp, file string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, file string").parquet(str(tmp_path / "in"))
    run = windowed_churn(stream).writeStream.outputMode("complete").format("memory").queryName("churned").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["start"].day, r["file"], r["churn"]) for r in spark.table("churned").collect()) == [(1, "a", 2), (1, "b", 1), (2, "a", 1), (5, "z", 1)]


def test_long_chains_of_re_exports_and_circles(spark):
    files = [("end.ts", "export function deep() { return 1; }\n"), *((f"b{i:03}.ts", f"export {{ deep }} from './{f'b{i - 1:03}' if i else 'end'}';\n") for i in range(90))]
    files += [("round.ts", "export { lost } from './back';\n"), ("back.ts", "export { lost } from './round';\n"), ("use.ts", "import { deep } from './b089';\nexport function use() { return deep(); }\n")]
    graph = typescript.source_graph(spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(files)], "path string, text string, ord long"))
    exported = {(r["file"], r["name"]): r["kind"] for r in graph.exports.collect()}
    assert exported["b089.ts", "deep"] == "function" and len(exported) == 92 and not any(n == "lost" for _, n in exported)
    assert ("use.ts::use", "end.ts::deep") in {(r["source"], r["target"]) for r in graph.call_edges.collect()}


def test_files_that_cannot_be_parsed_are_named(spark):
    texts = [("deep.ts", "export const a = 1;\n" + "`${" * 2000, 0), ("good.ts", "export const b = 1;\n", 1)]
    with pytest.warns(UserWarning, match="1 files can't be parsed: deep.ts"):
        graph = typescript.source_graph(spark.createDataFrame(texts, "path string, text string, ord long"))
    assert {(r["path"], r["loc"]) for r in graph.files.collect()} == {("deep.ts", 2), ("good.ts", 1)}
    assert [r["file"] for r in graph.exports.collect()] == ["good.ts"]
