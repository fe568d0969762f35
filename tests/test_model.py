import pytest

from tessera.errors import ConfigError
from tessera.functions.duration import parse_duration
from tessera.functions.env import expand, expand_connection
from tessera.model import ColumnSpec, Export, Incremental, Product, Source, Transform, load_product, mentions


def T(name, sql="SELECT 1 AS a", strategy="replace", key=None):
    return Transform(name=name, sql=sql, strategy=strategy, key=key or [])


def inc_source(name="ev"):
    return Source(name=name, kind="raw", uri="/x.parquet", incremental=Incremental(cursor="ts"))


def test_no_transforms_refused():
    with pytest.raises(ConfigError, match="no transforms"):
        Product(name="p")


@pytest.mark.parametrize("strategy,key,msg", [
    ("never", [], "not a strategy"),
    ("merge", [], "unknown strategy"),
    ("replace", ["a"], "not allowed with replace"),
    ("upsert", [], "needs a `key`"),
    ("append", [], "needs a `key`"),
])
def test_strategy_and_key_rules(strategy, key, msg):
    with pytest.raises(ConfigError, match=msg):
        Product(name="p", transforms=[T("t", strategy=strategy, key=key)])


def test_two_files_one_table_refused():
    with pytest.raises(ConfigError, match="both build table"):
        Product(name="p", transforms=[T("t"), T("t")])


def test_reserved_prefix_refused():
    with pytest.raises(ConfigError, match="reserved prefix"):
        Product(name="p", transforms=[T("__tessera_x")])


def test_replace_gate_whole_word_case_sensitive_and_comments():
    src = {"ev": inc_source()}
    with pytest.raises(ConfigError, match="incremental source 'ev'"):
        Product(name="p", sources=src, transforms=[T("r", "SELECT * FROM ev")])
    with pytest.raises(ConfigError):
        Product(name="p", sources=src, transforms=[T("r", "SELECT 1 -- reads ev later")])
    Product(name="p", sources=src, transforms=[T("r", "SELECT * FROM ev_acc")])  # not a whole word
    Product(name="p", sources=src, transforms=[T("r", "SELECT * FROM EV_X"), T("a", "SELECT * FROM ev", "upsert", ["id"])])
    assert mentions("x EV y", "EV") and not mentions("x EV y", "ev")


def test_grain_inherited_from_key_and_must_contain_key():
    p = Product(name="p", transforms=[T("t", strategy="upsert", key=["id"])],
                exports=[Export(name="t", schema={"id": ColumnSpec("int")})])
    assert p.exports[0].grain == ["id"] and p.exports[0].grain_inherited
    with pytest.raises(ConfigError, match="must contain"):
        Product(name="p", transforms=[T("t", strategy="upsert", key=["id"])], exports=[Export(name="t", grain=["x"])])
    r = Product(name="p", transforms=[T("t")], exports=[Export(name="t")])
    assert r.exports[0].grain == []  # never from replace


def test_supported_needs_description():
    with pytest.raises(ConfigError, match="no description"):
        Product(name="p", transforms=[T("t")], exports=[Export(name="t", contract="supported")])


def test_bound_export_rules():
    q = Source(name="q", kind="jdbc", connection={"url": "jdbc:x"}, query="select 1")
    with pytest.raises(ConfigError, match="query"):
        Product(name="p", sources={"q": q}, transforms=[T("t")], exports=[Export(name="e", bind="q")])
    raw = Source(name="r", kind="raw", uri="/r.parquet")
    with pytest.raises(ConfigError, match="exclusive"):
        Product(name="p", sources={"r": raw}, transforms=[T("t")], exports=[Export(name="e", bind="r", source="t")])
    Product(name="p", sources={"r": raw}, transforms=[T("t")], exports=[Export(name="e", bind="r")])


def test_prose_caps_and_semver():
    with pytest.raises(ConfigError, match="one line"):
        Product(name="p", description="x" * 201, transforms=[T("t")])
    with pytest.raises(ConfigError, match="unit"):
        Product(name="p", transforms=[T("t")], exports=[Export(name="t", schema={"a": ColumnSpec("int", unit="a b")})])
    with pytest.raises(ConfigError, match="semver"):
        Product(name="p", transforms=[T("t")], exports=[Export(name="t", version="2")])
    e = Export(name="orders_daily", version="2.1.0")
    assert e.route == "orders_daily@2"


def test_source_rules():
    with pytest.raises(ConfigError, match="exactly one"):
        Source(name="s", kind="jdbc", connection={}, table="a.b", query="q")
    with pytest.raises(ConfigError, match="incremental"):
        Source(name="s", kind="jdbc", connection={}, query="q", incremental=Incremental("ts"))
    with pytest.raises(ConfigError, match="shadow"):
        Product(name="p", sources={"t": Source(name="t", uri="/t.parquet")}, transforms=[T("t")])


def test_duration_grammar_three_errors():
    assert parse_duration("2h").total_seconds() == 7200
    assert parse_duration("1d").total_seconds() == 86400
    with pytest.raises(ConfigError, match="no unit"):
        parse_duration("30")
    with pytest.raises(ConfigError, match="not a duration"):
        parse_duration("2w")
    with pytest.raises(ConfigError, match="not a duration"):
        parse_duration("")
    with pytest.raises(ConfigError, match="zero"):
        parse_duration("0m")


def test_expand():
    env = {"A": "x"}
    assert expand("${A}/${B:-dflt}", env) == "x/dflt"
    with pytest.raises(ConfigError, match="unset"):
        expand("${B}", env)
    with pytest.raises(ConfigError, match="unterminated"):
        expand("${A", env)
    assert expand_connection("s", "select * from ${connection.project}.d.t", "prj") == "select * from prj.d.t"
    with pytest.raises(ConfigError):
        expand_connection("s", "${connection.dataset}", "prj")
    with pytest.raises(ConfigError):
        expand_connection("s", "${connection.project}", None)


def test_load_yaml(tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "stg.sql").write_text("SELECT * FROM raw")
    (tmp_path / "sql" / "acc.sql").write_text("SELECT * FROM stg")
    (tmp_path / "product.yaml").write_text(
        "product: demo\n"
        "sources:\n  raw: data/x.parquet\n"
        "transforms:\n  - sql/stg.sql\n  - {sql: sql/acc.sql, materialize: upsert, key: [id]}\n"
        "interface:\n  - {name: acc, version: 1.2.3, schema: {id: bigint, v: {type: string, unit: m}}}\n"
    )
    p = load_product(str(tmp_path / "product.yaml"))
    assert [t.name for t in p.transforms] == ["stg", "acc"]
    assert p.transforms[1].strategy == "upsert" and p.exports[0].grain == ["id"]
    assert p.sources["raw"].uri == str(tmp_path / "data" / "x.parquet")
    assert p.exports[0].schema["v"].unit == "m"


def test_profile_file_binds_connections_and_upstreams(tmp_path, monkeypatch):
    monkeypatch.setenv("CRM_URL", "jdbc:postgresql://db/crm")
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "joined.sql").write_text("SELECT * FROM accounts JOIN daily USING (region)")
    (tmp_path / "profile.yaml").write_text(
        "storage: ./.store\n"
        "connections:\n  crm: {url: '${CRM_URL}', user: '${CRM_USER:-reader}', driver: org.postgresql.Driver}\n"
        "products:\n  orders: /lake/products/orders\n"
    )
    (tmp_path / "product.yaml").write_text(
        "product: crm_orders\n"
        "sources:\n"
        "  accounts: {connection: crm, table: sales.accounts, incremental: {cursor: updated_at, lookback: 1d}}\n"
        "  daily: {product: orders, table: orders_daily, version: 3}\n"
        "  regions: {uri: data/regions.csv, options: {sep: ';'}}\n"
        "transforms:\n  - {sql: sql/joined.sql, materialize: upsert, key: [account_id]}\n"
        "access: {shareable: true}\n"
    )
    p = load_product(str(tmp_path / "product.yaml"), str(tmp_path / "profile.yaml"))
    acc = p.sources["accounts"]
    assert acc.kind == "jdbc" and acc.connection == {"url": "jdbc:postgresql://db/crm", "user": "reader",
                                                     "driver": "org.postgresql.Driver"}
    assert acc.incremental.cursor == "updated_at" and acc.incremental.lookback == "1d"
    daily = p.sources["daily"]
    assert daily.kind == "product" and daily.root == "/lake/products/orders" and daily.version == 3
    assert p.sources["regions"].options == {"sep": ";"}
    with pytest.raises(ConfigError, match="not in the profile"):
        load_product(str(tmp_path / "product.yaml"), {})
