import pytest
from pyspark.sql import functions as F

from stowage.functions import references as refs
from stowage.session import spread

# statement, table names, called functions
STATEMENTS = [
    ("select 1 as id", set(), set()),
    ("select * from p.ds.t a join ds.u b on a.x = b.x, `p.ds`.w, x", {"p.ds.t", "ds.u", "p.ds.w", "x"}, set()),
    ("select * from `p.ds.t` as t left anti join (select a from u) using (a)", {"p.ds.t", "u"}, set()),
    ("with c as (select 1 from base), d(a, b) as (select * from c) select * from C, d, other", {"base", "other"}, set()),
    ("with recursive r as (select 1 union all select * from r join s on 1 = 1) select * from r", {"s"}, set()),
    ("select * from a where x in (select y from b) group by z, w order by from_c", {"a", "b"}, set()),
    ("select extract(year from d), trim(both 'x' from s), substring(s from 2) from t", {"t"}, {"extract", "trim", "substring"}),
    ("select extract(year from (select max(d) from inner_t)) from t", {"inner_t", "t"}, {"extract", "max"}),
    ("select 'from x.y', \"from z\", r'from \\' -- from c\n, /* from d */ 1 from e", {"e"}, set()),
    ("select 'it''s from x', 'a\\' from y' from z", {"z"}, set()),
    ("select * from (a join b on a.i = b.i) c, lateral explode(arr), d", {"a", "b", "d"}, {"explode"}),
    ("select * from t lateral view explode(xs) e as x, y where x > 1", {"t"}, {"explode"}),
    ("select * from range(10) r, values (1), (2) as v", set(), {"range"}),
    ("select a is distinct from b, count(distinct c) from t", {"t"}, {"count"}),
    ("select db.f(x).field, `db`.g(1), h(2) from t pivot (sum(x) for y in (1, 2))", {"t"}, {"db.f", "db.g", "h", "sum"}),
    ("insert into ds.t (id, name) select id, name from s", {"ds.t", "s"}, set()),
    ("merge into m using s on m.i = s.i when matched then update set m.x = s.x", {"m", "s"}, set()),
    ("update t set x = (select max(y) from s)", {"t", "s"}, {"max"}),
    ("select * from my-project.ds.t join other-p.ds.u", {"my-project.ds.t", "other-p.ds.u"}, set()),
    ("select a-b.c, d-f(x) from t", {"t"}, {"f"}),
    ("select * from t1 union all select * from t2 except select * from t3", {"t1", "t2", "t3"}, set()),
    ("begin declare n string; set n = uuid(); insert into ds.t (id) values (1); select * from u; end", {"ds.t", "u"}, {"uuid"}),
    ("select * from a, (select * from b, c) d, e", {"a", "b", "c", "e"}, set()),
    ("select überschrift from größe", {"größe"}, set()),
]


@pytest.fixture(scope="module")
def statements(spark):
    return spark.createDataFrame([(i, s) for i, (s, *_rest) in enumerate(STATEMENTS)], "id int, sql string")


def test_tokens_lose_nothing(statements):
    joined = statements.select("sql", F.array_join(refs.tokens(F.col("sql")), "").alias("again"))
    assert all(r.sql == r.again for r in joined.collect())


def test_references(statements):
    found = {r.id: (set(r.tables), set(r.functions)) for r in refs.with_references(statements, "sql").collect()}
    expected = {i: (tables, functions) for i, (_, tables, functions) in enumerate(STATEMENTS)}
    assert found == expected


def test_one_row_per_reference_and_known_functions(spark, statements):
    rows = refs.table_references(statements, "sql").filter("id = 1").collect()
    assert sorted(r.reference for r in rows) == ["ds.u", "p.ds.t", "p.ds.w", "x"]
    known = spark.createDataFrame([("DB.F",), ("nothing",)], "name string")
    assert [r.reference for r in refs.function_references(statements, "sql", known).collect()] == ["db.f"]


def test_a_null_statement_has_no_references(spark):
    df = spark.createDataFrame([(None,)], "sql string")
    assert refs.table_references(df, "sql").count() == 0
    assert refs.rewrite_references(df, "sql", {"a": "b"}).first().sql is None


def test_qualify(spark):
    df = spark.createDataFrame([("t",), ("d.t",), ("p.d.t",)], "n string").select(refs.qualify(F.col("n"), "P", "D").alias("q"))
    assert [r.q for r in df.collect()] == ["P.D.t", "P.d.t", "p.d.t"]


def test_mapping_is_built_without_touching_the_callers():
    mine = {"other": "else"}
    assert refs.relocation_mapping("p", "a", "p", "b", mine) == {"other": "else", "p.a": "p.b", "a": "b"}
    assert mine == {"other": "else"}
    assert refs.relocation_mapping("p", "a", "p", "a") == {}


REWRITES = [
    ("select * from ds.t as ds where ds.x > 1", "select * from new.t as ds where ds.x > 1"),
    ("select * from ds_old.t join ds.t", "select * from ds_old.t join new.t"),
    ("select * from p.ds.t, DS.u", "select * from q.new.t, new.u"),
    ("select * from `p.ds`.t, `p`.`ds`.`odd name`", "select * from q.new.t, q.new.`odd name`"),
    ("select ds.t.x, p.ds.u.y.z from ds.t, p.ds.u", "select new.t.x, q.new.u.y.z from new.t, q.new.u"),
    ("select 'ds.t', \"ds.t\" /* ds.t */ from other.ds -- ds.t", "select 'ds.t', \"ds.t\" /* ds.t */ from other.ds -- ds.t"),
    ("with t as (select * from ds.base) select * from t", "with t as (select * from new.base) select * from t"),
    ("select ds.f(ds.g(x)).y, p.ds.h(1) from (select 1 x)", "select new.f(new.g(x)).y, q.new.h(1) from (select 1 x)"),
    ("select * from new.t", "select * from ds.t"),
    ("select  *\n from\tds . t", "select  *\n from\tds . t"),
]


def test_rewrite(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(REWRITES)], "id int, sql string")
    mapping = {"p.ds": "q.new", "ds": "new", "new": "ds"}
    found = {r.id: r.sql for r in refs.rewrite_references(df, "sql", mapping).collect()}
    assert found == {i: expected for i, (_, expected) in enumerate(REWRITES)}


def test_whole_table_names_go_before_dataset_names(spark):
    df = spark.createDataFrame([("select t.a, ds.u.b, v.c from t join ds.u join ds.w v",)], "sql string")
    found = refs.rewrite_references(df, "sql", {"ds": "new"}, {"t": "s", "ds.u": "x.y.z-1"}).first().sql
    assert found == "select s.a, x.y.`z-1`.b, v.c from s join x.y.`z-1` join new.w v"


def test_long_literals_do_not_overflow_the_matcher(spark):
    text = "select '" + "a''b\\'c" * 20000 + "' /*" + "*" * 50000 + "*/ from ds.t"
    df = spark.createDataFrame([(text,)], "sql string")
    assert refs.with_references(df, "sql").first().tables == ["ds.t"]


def test_blanks_and_comments_lie_before_their_token(spark):
    text = "\f from_c\x0b/* a\n-- b */ -- c\r\n+ 'x--y' /*/ z"
    df = spark.createDataFrame([(text,), ("",), (" -- only\n",)], "sql string")
    found = [r.t for r in df.select(refs.tokens(F.col("sql")).alias("t")).collect()]
    assert [p for p in found[0] if p] == ["\f from_c", "\x0b/* a\n-- b */ -- c\r\n+", " 'x--y'", " /", "*", "/", " z"]
    assert ["".join(t) for t in found] == [text, "", " -- only\n"]
    df = spark.createDataFrame([("select\ffrom_c from/**/ds.f--\n,\x0bfrom_t -- ds.u\r\n, ds.g-1, (ds.h -1) /* ds.i",)], "sql string")
    assert refs.with_references(df, "sql").first().tables == ["ds.f", "from_t", "ds.g-1", "ds.h"]
    renamed = refs.rewrite_references(df, "sql", {"ds": "new"}).first().sql
    assert renamed == "select\ffrom_c from/**/new.f--\n,\x0bfrom_t -- ds.u\r\n, new.`g-1`, (new.h -1) /* ds.i"


def test_tasks_have_bounded_rows(spark):
    rows = spark.range(0, 5000, 1, 40)
    assert spread(rows, "id", rows_per_task=50).rdd.getNumPartitions() == 100
    # Splits may be empty, so their number does not count.
    assert max(len(p) for p in spread(rows.where("id < 1000"), "id", rows_per_task=100).rdd.glom().collect()) < 250
