"""Small repositories, written for these tests, through the whole analysis."""

import pytest
from pyspark.sql import functions as F

from evgraph.operators import classify, diagrams, export, resolve
from evgraph.plans.analyze import analyze, ask

CSHARP = {
    "src/Shop/Shop.csproj": '<Project>\n  <ItemGroup>\n    <PackageReference Include="Serilog" Version="3.1" />\n    <ProjectReference Include="..\\Core\\Core.csproj" />\n  </ItemGroup>\n</Project>',
    "src/Core/Core.csproj": "<Project />",
    "src/Shop/OrdersController.cs": """namespace Shop;
[ApiController]
[Route("api/[controller]")]
public class OrdersController : ControllerBase
{
    private readonly IOrderService _orders;
    public OrdersController(IOrderService orders) { _orders = orders; }
    [HttpGet]
    public IActionResult List() { return Ok(_orders.All()); }
}
""",
    "src/Shop/IOrderService.cs": "namespace Shop;\npublic interface IOrderService\n{\n    object All();\n}\n",
    "src/Shop/OrderService.cs": 'namespace Shop;\npublic class OrderService : IOrderService\n{\n    private string Password = "Pwd=hunter2;";\n    public object All() { return null; }\n}\n',
    "src/Shop/ShopContext.cs": "namespace Shop;\npublic class ShopContext : DbContext\n{\n    public DbSet<Order> Orders { get; set; }\n}\npublic class Order\n{\n    public int Id { get; set; }\n}\n",
    "README.md": "# Shop\nOrders are listed.\n## Run\nStart it.\n",
    "node_modules/x/index.js": "export const hidden = () => 1",
    ".env": "SECRET=1",
}
WEB = {
    "package.json": '{\n  "name": "web",\n  "dependencies": {\n    "express": "4.0",\n    "react": "18"\n  }\n}',
    "src/api.ts": "import express from 'express'\n/* skipped\napp.get('/no')\n*/\nexport const router = 1\nrouter.get('/api/users', list)\n",
    "app/page.tsx": "export default function Page() {\n  return axios.get('/api/users')\n}\n",
    ".github/workflows/ci.yml": "name: CI\non: [push]\njobs:\n  build:\n    runs-on: ubuntu\n    steps:\n      - run: make\n  deploy:\n    needs: [build]\n    runs-on: ubuntu\n",
}


def analysed(spark, files, name):
    rows = [(p, len(t.encode()), bytearray(t.encode())) for p, t in files.items()]
    return analyze(spark.createDataFrame(rows, "path string, size long, content binary"), name)


@pytest.fixture(scope="module")
def shop(spark):
    return analysed(spark, CSHARP, "shop")


@pytest.fixture(scope="module")
def web(spark):
    return analysed(spark, WEB, "web")


def edges(made):
    return {(r["source_id"], r["type"], r["target_id"]) for r in made["edges"].collect()}


def test_csharp_graph(shop):
    found = edges(shop)
    assert {
        ("class:OrderService", "Implements", "interface:IOrderService"),
        ("class:OrdersController", "DependsOn", "interface:IOrderService"),
        ("class:OrdersController", "Exposes", "endpoint:get:/api/Orders"),
        ("class:ShopContext", "MapsTo", "entity:Order"),
        ("project:Shop", "DependsOn", "package:Serilog"),
        ("project:Shop", "DependsOn", "project:Core"),
    } <= found
    assert not [r for r in shop["edges"].collect() if not r["file_path"] or r["start_line"] < 1]
    assert shop["analysis_issues"].count() == 0
    assert not shop["nodes"].where(F.col("file_path").contains("node_modules")).count()


def test_web_graph(web):
    assert {
        ("project:package", "DependsOn", "package:express"),
        ("file:src/api.ts", "Exposes", "endpoint:get:/api/users"),
        ("file:src/api.ts", "DependsOn", "module:express"),
    } <= edges(web)
    assert ("endpoint:get:/no") not in {r["id"] for r in web["nodes"].collect()}
    assert any(t == "Calls" and to == "endpoint:get:/api/users" for _, t, to in edges(web))


def test_tables_are_the_same_again(spark, shop):
    again = analysed(spark, CSHARP, "shop")
    for name in ("projects", "source_files", "code_symbols", "evidences", "dependencies", "api_endpoints", "database_entities", "document_chunks"):
        ids = sorted(r["id"] for r in shop[name].collect())
        assert ids and len(set(ids)) == len(ids), name
        assert ids == sorted(r["id"] for r in again[name].collect()), name
    endpoint = shop["api_endpoints"].first()
    assert (endpoint["method"], endpoint["route"], endpoint["controller"], endpoint["action"]) == ("GET", "/api/Orders", "OrdersController", "List")
    kinds = {r["dependency_type"] for r in shop["dependencies"].collect()}
    assert {"PackageReference", "ProjectReference", "Implements"} <= kinds


def test_chunks_are_masked_and_numbered(shop):
    rows = shop["document_chunks"].orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert not any("hunter2" in r["content"] for r in rows)
    assert {r["symbol"] for r in rows if r["file_path"] == "README.md"} == {"# Shop", "## Run"}


def test_classification(spark, shop, web):
    def kind(made):
        row = classify.decide(classify.flags(made["raw"] if "raw" in made else made["source"], made["projects"], made["nodes"], made["edges"])).first()
        return row["repository_type"]

    for made, files, name, expected in ((shop, CSHARP, "shop", "ApiBackend"), (web, WEB, "web", "Frontend")):
        made["source"] = spark.createDataFrame([(name, p, t) for p, t in files.items()], "analysis_id string, path string, content string")
        assert kind(made) == expected


def test_diagrams(web, shop):
    nodes, links = diagrams.architecture(shop["nodes"], shop["edges"], shop["api_endpoints"])
    assert {"class:OrdersController", "entity:Order", "database"} <= {r["id"] for r in nodes.collect()}
    assert ("class:OrdersController", "interface:IOrderService") in {(r["source_id"], r["target_id"]) for r in links.collect()}
    assert "<svg" in export.page(nodes, links, "Shop & co")
    assert export.containers(nodes, links).count() == 1
    _, work = diagrams.workflow(web["ci_jobs"])
    assert (".github/workflows/ci.yml/build", ".github/workflows/ci.yml/deploy") in {(r["source_id"], r["target_id"]) for r in work.collect()}
    tiers, calls = diagrams.tiers(shop["source_files"], "universal")
    assert calls.count() and tiers.where("category = 'file'").count()
    for kind in ("erd", "endpoints", "architecture", "route_map", "namespace_class", "call_flow", "dependencies", "system_overview"):
        found = diagrams.dispatch(kind, shop)
        assert found is not None and found[0].count()
    cards = {r["id"]: r for r in diagrams.detail_cards(nodes, links).collect()}
    assert "class:OrdersController" in cards["interface:IOrderService"]["upstream"]


def test_dangling_edges_are_listed(shop):
    lost = {r["target_id"] for r in resolve.dangling(shop["nodes"], shop["edges"]).collect()}
    assert "class:OrdersController" not in lost


def test_questions(spark, shop):
    asked = spark.createDataFrame([("q1", "shop", "Which orders?"), ("q2", "other", "Anything?")], "question_id string, analysis_id string, question string")
    rows = {r["answer_id"]: r for r in ask(shop["document_chunks"], asked, dimension=32).collect()}
    assert rows["q1"]["status"] == "FullySupported"
    assert rows["q2"]["status"] == "InsufficientEvidence" and rows["q2"]["level"] == "Low"


def test_query_api(shop):
    from evgraph.operators import listing
    from evgraph.plans.api import Analysis

    api = Analysis(shop, "shop")
    assert [r["path"] for r in api.files(language="csharp", size=2).collect()] == ["src/Shop/IOrderService.cs", "src/Shop/OrderService.cs"]
    (found,) = api.endpoints(method="get", route="ORDERS").collect()
    assert (found["project"], api.endpoint(found["id"]).first()["file_path"]) == ("Shop", "src/Shop/OrdersController.cs")
    assert {r["target_id"] for r in api.dependencies("project:Shop", "outbound", "packagereference").collect()} == {"package:Serilog"}
    file_id = api.files(search="shopcontext").first()["id"]
    assert [c["name"] for c in api.file(file_id).first()["symbols"]][:1] == ["ShopContext"]
    assert api.file_content(file_id).first()["lines"] == 10
    assert {r["name"]: r["rows"] for r in api.overview().collect()}["projects"] == 2
    assert api.evidences(kind="nonsense").count() > 0
    kept = api.dependencies("project:Shop", "outbound", "packagereference").first()
    assert [e["file_path"] for e in api.dependency(kept["id"]).first()["evidence"]] == ["src/Shop/Shop.csproj"]
    entity = shop["database_entities"].first()
    _, proof = api.entity(entity["id"])
    assert proof.count() > 0 and all(r["description"] for r in proof.collect())
    assert api.status().first()["percent"] == 100
    with pytest.raises(listing.NotFound):
        api.evidence("none")
    with pytest.raises(listing.NotFound):
        Analysis(shop, "other")
