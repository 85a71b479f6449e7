import pytest

from tessella.symbols import graph, ranking, search
from tessella.symbols.extractor import extract_symbols
from tessella.symbols.store import KnowledgeBase, index_project, list_projects, scan_sources

SHOP = """using System;
using Alias = System.Text.Json;

namespace Shop.Core
{
    // class Hidden { }
    public enum Status { Open, [Obsolete] Closed = 2 }

    public interface IStore : IDisposable
    {
        void Load(string path);
    }

    [Serializable]
    public class Store<T> : BaseStore<T>, IStore where T : class
    {
        public const int Max = 5, Min = 1;
        [SerializeField] private float rate = 0.5f;
        private int hidden;
        public event Action<Status> Changed;
        public Status Current { get; private set; } = Status.Open;
        public string Name => "a { b";
        protected internal int Count { set { hidden = value; } }
        public Store(string path) { Load(path); }

        private void Awake() { Debug.Log($"start {Current}"); }
        public async Task<List<int>> Fetch(ref int a, params string[] names)
        {
            var item = GetComponent<Rigidbody>();
            if (item == null) { return await Other.Run(a); }
            return new List<int>();
        }
        private void Secret() { }
        public class Inner { public int X; }
    }
}
"""
USE = """namespace Shop.Web;
public class Page : Store<int>
{
    public IStore store;
    void Update() { Physics.Raycast(store); }
}
"""


def test_extraction():
    got = extract_symbols(SHOP)
    assert got["usings"] == ["System", "System.Text.Json"]
    kinds = [(s["name"], s["kind"], s["line"], s["endLine"], s["bases"]) for s in got["symbols"]]
    assert kinds == [("Status", "enum", 7, 7, None), ("IStore", "interface", 9, 12, ["IDisposable"]), ("Store", "class", 14, 35, ["BaseStore<T>", "IStore"]), ("Inner", "class", 34, 34, None)]
    store = got["symbols"][2]
    assert store["namespace"] == "Shop.Core" and store["attributes"] == ["Serializable"]
    members = {m["name"]: (m["kind"], m["signature"]) for m in store["members"]}
    assert members == {
        "Max": ("field", "public const int Max"),
        "rate": ("field", "private float rate"),
        "Current": ("property", "public Status Current { get; set; }"),
        "Name": ("property", "public string Name"),
        "Count": ("property", "protected internal int Count { set; }"),
        "Awake": ("method", "private void Awake()"),
        "Fetch": ("method", "public async Task<List<int>> Fetch(int a, string[] names)"),
    }
    assert [m["isUnityMessage"] for m in store["members"] if m["name"] in ("Awake", "Fetch")] == [True, None]
    assert [m["name"] for m in got["symbols"][0]["members"]] == ["Open", "Closed"]
    deps = got["dependencies"]
    assert deps["calls"] == ["Debug.Log", "GetComponent<Rigidbody>"] and {"BaseStore", "Rigidbody", "Current", "Task"} <= set(deps["types"]) and "Hidden" not in deps["types"]
    for odd in ("", "class", "public class A {", 'string s = "unclosed', "}}}} namespace X { class B {}"):
        extract_symbols(odd)


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root, data = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("kb")
    (root / "Core").mkdir()
    (root / "Core" / "Store.cs").write_text(SHOP)
    (root / "Page.cs").write_text(USE)
    (root / "bin").mkdir()
    (root / "bin" / "Skip.cs").write_text(USE)
    (root / "Gen").mkdir()
    (root / "Gen" / "G.cs").write_text("class G {}")
    (root / ".gitignore").write_text("# made\nGen/\n*.tmp.cs\n")
    (root / "x.tmp.cs").write_text("class T {}")
    found = index_project(spark, str(root), "shop", str(data))
    assert list_projects(spark, str(data)) == ["shop"]
    assert sorted(r["relativePath"] for r in scan_sources(spark, str(root), exclude=["Core"]).select("relativePath").collect()) == ["Page.cs"]
    return found.cache(), str(data)


def test_index(kb):
    base, _ = kb
    assert base.meta["fileCount"] == 2 and base.meta["symbolCount"] == 5
    rows = {r["relativePath"]: r for r in base.files.collect()}
    assert set(rows) == {"Core/Store.cs", "Page.cs"} and rows["Page.cs"]["symbolCount"] == 1 and len(rows["Page.cs"]["hash"]) == 16


def test_search_and_find(kb):
    base, _ = kb
    got = [(r["symbol"], r["match"]) for r in search.search(base, "STORE").collect()]
    assert got == [("IStore", "name"), ("Store", "name"), ("Page.store", "member")]
    assert [r["symbol"] for r in search.search(base, "task", kind="class").collect()] == ["Store.Fetch"]
    assert [r["symbol"] for r in search.search(base, "o", namespace="Shop.Web").collect()] == ["Page.store", "Page.Update"]
    assert [(r["symbol"], r["memberCount"]) for r in search.find(base, is_unity_message=True).collect()] == [("Store", 7), ("Page", 2)]
    assert search.find(base, is_unity_message=False).count() == 0
    assert [r["symbol"] for r in search.implementations(base, "Store").collect()] == ["Store", "Page"]
    assert [r["symbol"] for r in search.find(base, kind="class", has_member="fet").collect()] == ["Store"]
    assert [r["symbol"] for r in search.find(base, has_attribute="Serial", limit=1).collect()] == ["Store"]
    assert search.get_symbol(base, "store").first() is None and search.get_symbol(base, "Store", "Shop").first()["line"] == 14
    with pytest.raises(FileNotFoundError):
        search.file_symbols(base, "none.cs")


def test_stats_namespaces(kb):
    base, _ = kb
    assert search.stats(base) == {"files": 2, "symbols": 5, "namespaces": 2, "topNamespaces": [("Shop.Core", 4), ("Shop.Web", 1)]}
    assert search.stats(base, "Shop.W")["files"] == 1
    assert [r[0] for r in search.list_namespaces(base, "Shop").collect()] == ["Shop.Core", "Shop.Web"]
    assert search.namespace_summary(base, "Shop.Core").count() == 4
    assert search.export(base, file="Page.cs").collect()[0]["dependencies"]["calls"] == ["Physics.Raycast"]


def test_graph(spark, kb):
    base, _ = kb
    out = graph.dependencies(base, "page")
    assert [r["name"] for r in out["outgoing"]] == ["Store", "IStore"] and out["incoming"] == []
    into = graph.dependencies(base, "IStore", "in", 2)
    assert {(r["name"], r["depth"]) for r in into["incoming"]} == {("Status", 1), ("IStore", 1), ("Store", 1), ("Inner", 1), ("Page", 1)}
    assert graph.dependencies(base, "Nothing") is None
    assert graph.resolve_type(base, "Shop.Core.Store, Shop", True)["incoming"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {tuple(r) for r in graph.expand(edges, spark.createDataFrame([("a",)], "node string"), 9).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_ranking(kb):
    base, _ = kb
    out = ranking.context(base, "Fix the store page loading")
    assert [f["file"] for f in out["files"]] == ["Core/Store.cs", "Page.cs"]
    # path +3; Store name 10, IStore contains 5
    assert out["files"][0]["score"] == 3 + 10 + 5 and out["files"][0]["matchedSymbols"] == ["IStore", "Store"]
    assert out["interfaceMap"] == [{"interface": "IStore", "implementations": ["Store"]}] and out["startingPoints"][0].startswith("IStore, Store in Core")
    assert [f["file"] for f in ranking.context(base, "store", exclude=["Core*"])["files"]] == ["Page.cs"]
    answer = ranking.ask(base, "Where is the store?")
    assert answer["files"][0]["symbol"] == "Store" and answer["files"][0]["score"] == 20 and "What classes inherit from BaseStore<T>?" in answer["suggestedQuestions"]
    assert ranking.ask(base, "zzz")["files"] == []


def test_json_layout(spark, kb, tmp_path):
    base, _ = kb
    base.to_json(str(tmp_path / "out"))
    again = KnowledgeBase.from_json(spark, str(tmp_path / "out"))
    assert again.meta["symbolCount"] == 5 and again.symbols.count() == 5
