"""The command line over a catalog."""

from cellgrid.catalog import Catalog
from cellgrid.cli import main, parser, run


def test_commands(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/root"
    catalog = Catalog(spark, root, clock=lambda: 0.005)
    do = lambda *words: run(catalog, parser().parse_args(["--root", root, "--db", "d", *words]))
    assert do("create-database", "d", "--axes", "2", "--world-dim", "100", "--chunk-dim", "8") == "created\n"
    assert do("databases") == "d\n"
    assert do("set", "1,2", "name", "str", "rock") == "set\n" and do("get", "1, 2", "name") == "rock\n" and do("get", "0,0", "name") == "not set\n"
    assert do("query", "SET (n = 1) IN (0,0) TO (2,2)") == "4 cells affected\n"
    assert do("query", "SELECT count(*), mean(n), max(nope)") == "count(*) = 5.0\nmean(n) = 1.0\nmax(nope) = none\n"
    assert do("query", "SELECT name WHERE EXISTS(name)") == "(1, 2) name='rock' (created 5, updated 5, version 0)\n1 rows\n"
    assert do("query", "CREATE INDEX ON n") == "done\n"
    assert do("add-column", "hot", "bool") == "added\n" and do("columns") == "hot bool\nn i64\nname str\n"
    assert do("remove-column", "n") == "removed\n" and do("remove-column", "n") == "no such column\n"
    assert do("remove", "1,2", "name") == "removed\n" and do("remove", "1,2", "name") == "not set\n"
    assert main(["--root", root, "--db", "d", "query", "SELECT *, a"]) == 1 and "BadRequest" in capsys.readouterr().err
    assert main(["--root", root, "--db", "d", "set", "1,2", "n", "i64", "x"]) == 1
    assert main(["--root", root, "--read-only", "--db", "d", "query", "DELETE"]) == 1
    assert do("remove-database", "d") == "removed\n" and do("remove-database", "d") == "no such database\n"
