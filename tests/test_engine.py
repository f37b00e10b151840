"""Statements: tables, inserts, deletes, alterations, indexes, registration, statistics."""

import pytest

from tessera.registry import CatalogError, RegistryError


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def people(engine):
    engine.sql("CREATE TABLE dh.people (id INTEGER, name VARCHAR, age INTEGER)")
    engine.sql("INSERT INTO dh.people VALUES (1, 'Ann', 30), (2, 'Bob', NULL), (3, 'Cy', 50)")


def test_create_insert_select_drop(engine):
    people(engine)
    assert rows(engine, "SELECT * FROM dh.people ORDER BY id") == [(1, "Ann", 30), (2, "Bob", None), (3, "Cy", 50)]
    with pytest.raises(CatalogError, match="already exists"):
        engine.sql("CREATE TABLE dh.people (id INTEGER)")
    engine.sql("CREATE TABLE IF NOT EXISTS dh.people (id INTEGER)")
    engine.sql("DROP TABLE dh.people")
    with pytest.raises(CatalogError, match="Table with name people does not exist"):
        engine.sql("SELECT * FROM dh.people")
    engine.sql("DROP TABLE IF EXISTS dh.people")
    with pytest.raises(CatalogError):
        engine.sql("DROP TABLE dh.people")


def test_delete_keeps_rows_with_a_null_predicate_and_goes_by_any_column(engine):
    people(engine)
    engine.sql("INSERT INTO dh.people VALUES (1, 'Dee', 20)")
    engine.sql("DELETE FROM dh.people WHERE age >= 30")
    assert rows(engine, "SELECT id, name FROM dh.people ORDER BY name") == [(2, "Bob"), (1, "Dee")]
    engine.sql("DELETE FROM dh.people")
    assert rows(engine, "SELECT * FROM dh.people") == []


def test_delete_rewrites_only_files_that_match(engine):
    people(engine)
    engine.sql("INSERT INTO dh.people VALUES (9, 'Zoe', 9)")
    before = {f for g in engine.store.meta("people")["groups"] for f in g["files"]}
    engine.sql("DELETE FROM dh.people WHERE id = 9")
    after = {f for g in engine.store.meta("people")["groups"] for f in g["files"]}
    assert after < before and engine.store.row_count("people") == 3


def test_update(engine):
    people(engine)
    assert rows(engine, "UPDATE dh.people SET age = age + 1, name = 'x' WHERE id <> 2") == [(2,)]
    assert rows(engine, "SELECT * FROM dh.people ORDER BY id") == [(1, "x", 31), (2, "Bob", None), (3, "x", 51)]


def parcels(engine):
    engine.sql("CREATE TABLE dh.parcels (code VARCHAR, grams BIGINT)")
    engine.sql("INSERT INTO dh.parcels VALUES ('p-1', 250), ('p-2', 900)")


def test_columns_come_and_go_without_touching_files(engine):
    parcels(engine)
    files = [g["files"] for g in engine.store.meta("parcels")["groups"]]
    for action in ("ADD COLUMN route VARCHAR DEFAULT 'sea'", "ADD COLUMN weight_class INTEGER", "RENAME COLUMN grams TO mass", "DROP COLUMN weight_class"):
        engine.sql(f"ALTER TABLE dh.parcels {action}")
    assert [g["files"] for g in engine.store.meta("parcels")["groups"]] == files
    assert rows(engine, "SELECT code, mass, route FROM dh.parcels ORDER BY mass") == [("p-1", 250, "sea"), ("p-2", 900, "sea")]


def test_a_column_added_again_is_a_new_one(engine):
    parcels(engine)
    engine.sql("ALTER TABLE dh.parcels DROP COLUMN grams")
    engine.sql("ALTER TABLE dh.parcels ADD COLUMN IF NOT EXISTS grams BIGINT")
    engine.sql("ALTER TABLE dh.parcels ADD COLUMN IF NOT EXISTS grams VARCHAR")  # nothing to do
    engine.sql("INSERT INTO dh.parcels (grams) VALUES (7)")
    assert rows(engine, "SELECT grams, code FROM dh.parcels ORDER BY code NULLS FIRST") == [(7, None), (None, "p-1"), (None, "p-2")]


def test_defaults_hold_from_when_they_are_set(engine):
    parcels(engine)
    engine.sql("ALTER TABLE dh.parcels ADD COLUMN route VARCHAR DEFAULT 'sea'")
    engine.sql("ALTER TABLE dh.parcels ALTER COLUMN route SET DEFAULT 'air'")
    engine.sql("INSERT INTO dh.parcels (code) VALUES ('p-3')")
    engine.sql("INSERT INTO dh.parcels (code, route) VALUES ('p-4', NULL)")
    engine.sql("ALTER TABLE dh.parcels ALTER COLUMN route DROP DEFAULT")
    engine.sql("INSERT INTO dh.parcels (code) VALUES ('p-5')")
    assert rows(engine, "SELECT route FROM dh.parcels ORDER BY code") == [("sea",), ("sea",), ("air",), (None,), (None,)]


def test_type_change_shows_in_the_schema(engine):
    parcels(engine)
    engine.sql("ALTER TABLE dh.parcels ALTER grams SET DATA TYPE DECIMAL(9,1)")
    assert engine.sql("SELECT grams FROM dh.parcels").schema["grams"].dataType.simpleString() == "decimal(9,1)"


def test_alterations_that_are_refused(engine):
    parcels(engine)
    for action in ("DROP COLUMN no_such", "RENAME COLUMN no_such TO x", "ADD COLUMN code INTEGER", "RENAME COLUMN code TO grams"):
        with pytest.raises(CatalogError):
            engine.sql(f"ALTER TABLE dh.parcels {action}")
    engine.sql("ALTER TABLE dh.parcels DROP COLUMN IF EXISTS no_such")
    engine.sql("ALTER TABLE IF EXISTS dh.crates DROP COLUMN code")
    with pytest.raises(CatalogError, match="Table with name crates does not exist"):  # also if only the column may be missing
        engine.sql("ALTER TABLE dh.crates DROP COLUMN IF EXISTS code")
    with pytest.raises(NotImplementedError):
        engine.sql("ALTER TABLE dh.parcels PARTITION BY code")


def test_not_null(engine):
    people(engine)
    with pytest.raises(CatalogError):
        engine.sql("ALTER TABLE dh.people ALTER COLUMN age SET NOT NULL")
    engine.sql("ALTER TABLE dh.people ALTER COLUMN name SET NOT NULL")
    with pytest.raises(Exception, match="NOT NULL constraint failed"):
        engine.sql("INSERT INTO dh.people VALUES (4, NULL, 1)")
    assert engine.store.row_count("people") == 3
    engine.sql("ALTER TABLE dh.people ALTER COLUMN name DROP NOT NULL")
    engine.sql("INSERT INTO dh.people VALUES (4, NULL, 1)")


def test_failed_type_change_changes_nothing(engine):
    people(engine)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        engine.sql("ALTER TABLE dh.people ALTER COLUMN name TYPE INTEGER")
    assert rows(engine, "SELECT name FROM dh.people WHERE id = 1") == [("Ann",)]


def test_rename_moves_the_mapping(engine):
    engine.sql("PRAGMA register_remote_table('p', 'people')")
    people(engine)
    engine.sql("ALTER TABLE dh.people RENAME TO folk")
    assert rows(engine, "SELECT COUNT(*) FROM dh.p") == [(3,)] and engine.registry.resolve("p") == "folk"


def test_a_late_commit_fails(engine):
    people(engine)
    stale = engine.store.meta("people")
    engine.sql("INSERT INTO dh.people VALUES (4, 'Dee', 1)")
    with pytest.raises(Exception, match="exists"):
        engine.store.commit("people", stale)


def test_indexes(engine):
    people(engine)
    engine.sql("CREATE INDEX by_id ON dh.people(id)")
    with pytest.raises(CatalogError):
        engine.sql("CREATE INDEX by_id ON dh.people(id)")
    engine.sql("CREATE INDEX by_name ON dh.people(name)")
    listed = "SELECT index_name FROM dh_indexes() WHERE database_name = 'dh' AND table_name = 'people' ORDER BY index_name"
    assert rows(engine, listed) == [("by_id",), ("by_name",)]
    engine.sql("DROP INDEX dh.by_id")
    engine.sql("DROP INDEX IF EXISTS dh.by_id")
    with pytest.raises(CatalogError):
        engine.sql("DROP INDEX dh.by_id")
    assert rows(engine, listed) == [("by_name",)]


def test_registration(engine):
    engine.sql("PRAGMA register_remote_table('t', 't')")
    with pytest.raises(RegistryError, match="Failed to register table t because it's already registered!"):
        engine.sql("PRAGMA register_remote_table('t', 't')")
    engine.sql("PRAGMA unregister_remote_table('t')")
    for name in ("t", "other"):
        with pytest.raises(RegistryError, match=f"Failed to unregister table {name} because it hasn't been registered!"):
            engine.sql(f"PRAGMA unregister_remote_table('{name}')")


def count_of_workers(engine):
    return engine.sql("SELECT get_worker_count()").first()[0]


def test_workers_register_with_a_server_that_runs(engine):
    with pytest.raises(RuntimeError):
        engine.sql("SELECT register_worker('early', 'grpc://node:7')")
    engine.sql("SELECT start_local_server(7000, 2)")
    assert count_of_workers(engine) == 2
    engine.sql("SELECT main.register_worker('more', 'grpc://node:7')")
    engine.sql("SELECT register_or_replace_driver('one', 'grpc://head:7000')")
    engine.sql("SELECT register_or_replace_driver('other', 'grpc://head:7000')")  # drivers are no workers
    assert count_of_workers(engine) == 3


def test_a_port_is_taken_once_and_all_ends_with_the_server(engine):
    engine.sql("SELECT start_local_server(7000)")
    engine.sql("SELECT start_standalone_worker(7001)")
    with pytest.raises(ValueError):
        engine.sql("SELECT start_standalone_worker(7001)")
    assert count_of_workers(engine) == 1
    engine.sql("SELECT stop_local_server()")
    assert count_of_workers(engine) == 0


def test_attach_needs_its_name(engine):
    engine.sql("ATTACH DATABASE 'dh' (TYPE any, server_host 'localhost', server_port 8815)")
    assert engine.server == {"host": "localhost", "port": "8815", "path": ""}
    with pytest.raises(CatalogError):
        engine.sql("ATTACH DATABASE 'other' (TYPE any)")


def test_statistics(engine):
    engine.sql("SELECT start_local_server(8815, 4)")
    people(engine)
    engine.execute("SELECT name, COUNT(*) AS n FROM dh.people GROUP BY name")
    engine.execute("SELECT * FROM dh.people ORDER BY id")
    got = rows(engine, "SELECT execution_mode, merge_strategy, num_workers_used, num_tasks_generated FROM get_query_execution_stats()")
    assert got == [("DELEGATED", "GROUP_BY_MERGE", 4, 1), ("LOCAL", "CONCATENATE", 4, 1)]
    assert rows(engine, "SELECT COUNT(*) > 0 FROM get_query_history()") == [(True,)]
    engine.sql("SELECT clear_query_recorder_stats()")
    assert rows(engine, "SELECT COUNT(*) FROM get_query_history()") == [(0,)]
    assert rows(engine, "SELECT COUNT(*) FROM get_query_execution_stats()") == [(0,)]


def test_enum_tables(engine):
    engine.sql("CREATE TYPE mood AS ENUM ('happy', 'sad', 'neutral')")
    with pytest.raises(ValueError):
        engine.sql("CREATE TYPE mood AS ENUM ('a')")
    engine.sql("CREATE TABLE dh.m (id INTEGER, m mood, l INTEGER[], u UTINYINT, d DECIMAL(10,2) DEFAULT 1.5)")
    engine.sql("INSERT INTO dh.m (id, m, l, u) VALUES (1, 'happy', array(1, NULL), 255), (2, NULL, array(), NULL)")
    assert rows(engine, "SELECT id, m, l, u, cast(d AS string) FROM dh.m ORDER BY id") == [(1, "happy", [1, None], 255, "1.50"), (2, None, [], None, "1.50")]
    for bad in ("(3, 'angry', NULL, 1)", "(3, 'sad', NULL, 256)", "(3, 'sad', NULL, -1)"):
        with pytest.raises(Exception, match="has no label|out of range"):
            engine.sql(f"INSERT INTO dh.m (id, m, l, u) VALUES {bad}")
    assert engine.store.row_count("m") == 2


def test_names_in_texts_and_subqueries(engine):
    people(engine)
    assert rows(engine, "SELECT 'FROM dh.people' AS t FROM dh.people WHERE id = (SELECT MAX(id) FROM dh.people)") == [("FROM dh.people",)]
    assert rows(engine, "WITH p AS (SELECT * FROM dh.people), people2 AS (SELECT id FROM p) SELECT COUNT(*) FROM people2 JOIN people ON people2.id = people.id") == [(3,)]


def test_load_extension(engine):
    assert rows(engine, "SELECT load_extension('json')") == [(True,)]
    with pytest.raises(Exception):
        engine.sql("SELECT load_extension('no_such_format')")


def test_predicates_with_subqueries(engine):
    people(engine)
    engine.sql("CREATE TABLE dh.banned (who INTEGER)")
    engine.sql("INSERT INTO dh.banned VALUES (1), (NULL)")
    engine.sql("UPDATE dh.people SET age = (SELECT MAX(age) FROM dh.people), name = concat(name, '!') WHERE EXISTS (SELECT 1 FROM dh.banned WHERE who = people.id)")
    assert rows(engine, "SELECT * FROM dh.people ORDER BY id") == [(1, "Ann!", 50), (2, "Bob", None), (3, "Cy", 50)]
    assert rows(engine, "DELETE FROM dh.people WHERE id NOT IN (SELECT who FROM dh.banned)") == [(0,)]  # null for all others
    assert rows(engine, "DELETE FROM dh.people WHERE id IN (SELECT who FROM dh.banned) OR age IS NULL") == [(2,)]
    assert rows(engine, "SELECT id FROM dh.people") == [(3,)]
    assert not [v.name for v in engine.spark.catalog.listTables() if v.name.startswith("tessera_")]


def test_views_are_resolved_when_they_are_read(engine, spark):
    from tessera.engine import Engine

    people(engine)
    engine.sql("CREATE VIEW dh.old AS SELECT * FROM dh.people WHERE age >= 40")
    engine.sql("CREATE TEMP VIEW names AS SELECT name FROM old")
    engine.sql("INSERT INTO dh.people VALUES (4, 'Di', 90)")
    assert rows(engine, "SELECT name FROM names ORDER BY name") == [("Cy",), ("Di",)]
    again = Engine(spark, engine.store.root)
    assert rows(again, "SELECT COUNT(*) FROM dh.old") == [(2,)]
    with pytest.raises(Exception, match="names"):
        again.sql("SELECT * FROM names")
    for bad in ("CREATE VIEW dh.old AS SELECT 1", "CREATE VIEW dh.people AS SELECT 1", "CREATE TABLE dh.old (i INTEGER)", "DROP VIEW dh.nothing"):
        with pytest.raises(CatalogError):
            engine.sql(bad)
    with pytest.raises(Exception, match="no_such"):
        engine.sql("CREATE VIEW dh.broken AS SELECT no_such FROM dh.people")
    engine.sql("CREATE VIEW IF NOT EXISTS dh.old AS SELECT 1")
    engine.sql("CREATE OR REPLACE VIEW dh.old AS SELECT 7 AS seven")
    assert rows(engine, "SELECT * FROM old") == [(7,)]
    engine.sql("DROP VIEW dh.old")
    engine.sql("DROP VIEW IF EXISTS dh.old")
    with pytest.raises(CatalogError):
        engine.sql("SELECT * FROM dh.old")


def test_schemas(engine):
    people(engine)
    engine.sql("CREATE SCHEMA dh.hr")
    engine.sql("CREATE SCHEMA IF NOT EXISTS hr")
    engine.sql("CREATE TABLE dh.hr.people (id INTEGER)")
    engine.sql("INSERT INTO hr.people VALUES (77)")
    engine.sql("ALTER TABLE hr.people RENAME TO staff")
    assert rows(engine, "SELECT s.id, p.name FROM hr.staff s, main.people p WHERE p.id = 3") == [(77, "Cy")]
    assert rows(engine, "SELECT schema_name, table_name FROM dh_tables() ORDER BY 1") == [("hr", "staff"), ("main", "people")]
    for bad in ("CREATE SCHEMA hr", "DROP SCHEMA hr", "DROP SCHEMA main", "DROP SCHEMA nothing", "CREATE TABLE nothing.t (i INTEGER)"):
        with pytest.raises(CatalogError):
            engine.sql(bad)
    engine.sql("DROP SCHEMA hr CASCADE")
    engine.sql("DROP SCHEMA IF EXISTS hr")
    assert engine.store.tables() == ["people"]


def test_list_syntax(engine):
    engine.sql("CREATE TABLE dh.l (id INTEGER, i INTEGER[], s VARCHAR[], d DATE[])")
    engine.sql("INSERT INTO dh.l VALUES (1, [4, NULL, 6], ['a]', 'b'], ['2024-02-29']), (2, [], NULL, []), (3, NULL, ['x'], NULL)")
    assert rows(engine, "SELECT id, len(i), i[1], i[-1], i[0], i[9], s[1], len(s[1]) FROM dh.l ORDER BY id") == [(1, 3, 4, 6, None, None, "a]", 2), (2, 0, None, None, None, None, None, None), (3, None, None, None, None, None, "x", 1)]
    assert rows(engine, "SELECT id FROM dh.l WHERE len(i) > 2 AND list_contains(i, 6) AND NOT list_contains(i, 5)") == [(1,)]
    assert rows(engine, "SELECT unnest(i) AS x FROM dh.l ORDER BY x NULLS LAST") == [(4,), (6,), (None,)]
    assert rows(engine, "SELECT i[2:], i[:1], [[1], [2, 3]][2][1], 'no [1]' FROM dh.l WHERE id = 1") == [([None, 6], [4], 2, "no [1]")]
    assert rows(engine, 'SELECT "id" FROM dh.l WHERE i = [4, NULL, 6] OR s = [\'x\']::VARCHAR[] ORDER BY "id"')[-1] == (3,)
    assert rows(engine, "UPDATE dh.l SET i = [len(s), 0] WHERE len(s) = 1") == [(1,)]
    assert rows(engine, "SELECT i FROM dh.l WHERE id = 3") == [([1, 0],)]


def test_types_outlive_the_session(engine, spark):
    from tessera.engine import Engine

    engine.sql("CREATE TYPE size AS ENUM ('small', 'large')")
    engine.sql("CREATE TABLE dh.shirts (id INTEGER, s size)")
    again = Engine(spark, engine.store.root)
    again.sql("INSERT INTO dh.shirts VALUES (1, 'large')")
    with pytest.raises(Exception, match="has no label"):
        again.sql("INSERT INTO dh.shirts VALUES (2, 'huge')")
    with pytest.raises(ValueError):
        again.sql("CREATE TYPE size AS ENUM ('x')")
    assert rows(again, "SELECT s FROM dh.shirts") == [("large",)]


def test_renaming_is_one_move(engine, monkeypatch):
    people(engine)
    monkeypatch.setattr(engine.store, "commit", lambda *_: pytest.fail("no commit is needed"))
    engine.sql("ALTER TABLE dh.people RENAME TO folk")
    assert rows(engine, "SELECT COUNT(*) FROM dh.folk") == [(3,)] and not engine.store.exists("people")


def test_readers_see_whole_versions_only(engine):
    people(engine)
    folder = f"{engine.store.folder('people')}/versions"
    files = engine.store.files
    stream = files.fs.create(files.path(f"{folder}/.000000000099.json-left-behind"), False)
    stream.write(bytearray(b"{"))
    stream.close()
    assert engine.store.row_count("people") == 3
    assert all(n.endswith(".json") for n in files.names(folder))


def test_of_two_writers_one_wins(engine, spark):
    from tessera.engine import Engine

    people(engine)
    other = Engine(spark, engine.store.root)
    mine, theirs = engine.store.meta("people"), other.store.meta("people")
    mine["columns"][0]["name"], theirs["columns"][0]["name"] = "a", "b"
    engine.store.commit("people", mine)
    with pytest.raises(Exception, match="exists"):
        other.store.commit("people", theirs)
    assert other.sql("SELECT * FROM dh.people").columns[0] == "a"


def test_compaction(engine):
    for i in range(5):
        engine.sql("CREATE TABLE IF NOT EXISTS dh.n (i INTEGER)")
        engine.sql(f"INSERT INTO dh.n VALUES ({i})")
    engine.sql("ALTER TABLE dh.n ADD COLUMN s VARCHAR DEFAULT 'x'")
    assert engine.store.compact("n") == 1 and len(engine.store.meta("n")["groups"]) == 1
    assert rows(engine, "SELECT i, s FROM dh.n ORDER BY i") == [(i, "x") for i in range(5)] and engine.store.row_count("n") == 5


def test_bulk_insert_of_arrow(engine):
    import pyarrow as pa

    engine.sql("CREATE TABLE dh.a (k BIGINT, t VARCHAR DEFAULT 'none')")
    assert engine.insert_arrow("a", pa.table({"k": [1, 2]})) == 2
    assert engine.insert_arrow("dh.a", pa.table({"t": ["x", None], "k": [3, 4]})) == 2
    assert rows(engine, "SELECT * FROM dh.a ORDER BY k") == [(1, "none"), (2, "none"), (3, "x"), (4, None)]
