"""Constants of C# sources: every declarator, wherever it stands."""

from conftest import rows
from depweft.operators import extract

SOURCE = """[Attr(X, Name = "no")]
class A {
  const string A = "x"; const string B = "y";
  const string C = "x", D = "a\\"b,;", E = Other + "q", F = "z";
  public const string
    G =
      "late", H = "h";
  public string Mode { get; set; } = "m"; const string I = J, K = "k";
  string plain = "no"; int n = 1, m = "no";
}
"""


def test_every_declarator(spark):
    files = spark.createDataFrame([("r", "a/A.CS", SOURCE), ("r", "b.txt", SOURCE), ("r", "c.cs", None), ("r", "d.cs", 'const string Z = "' + "v" * 100_000 + '";' + " x" * 200_000)], "repo string, path string, content string")
    got = rows(extract.constants(files).select("key", "value", "source", "layer"))
    want = [("A", "x", 3), ("B", "y", 3), ("C", "x", 4), ("D", 'a\\"b,;', 4), ("F", "z", 4), ("G", "late", 6), ("H", "h", 7), ("Mode", "m", 8), ("K", "k", 8)]
    assert got == sorted([*((k, v, f"a/A.CS:{n}", 2) for k, v, n in want), ("Z", "v" * 100_000, "d.cs:1", 2)], key=repr)
