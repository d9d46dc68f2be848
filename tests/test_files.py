"""Folders with names that Spark's own listing leaves out."""

from loamgraph.api import Engine, Limits
from loamgraph.plans.shared import _hadoop_path
from loamgraph.sources import files


def test_hidden_names_are_read(spark, tmp_path):
    texts = {"a.md": "plain", "pkg/__init__.py": "x = 1", "_posts/one.md": "first", "_posts/deep/_two.md": "second", ".notes.md": "dotted", "_big.txt": "z" * 2_000_001, ".git/c.md": "no", "~$x.md": "no", "_blank.txt": " "}
    for name, text in texts.items():
        path = tmp_path / "lab" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = str(tmp_path / "lab")
    kept = {"a.md", "pkg/__init__.py", "_posts/one.md", "_posts/deep/_two.md", ".notes.md", "_big.txt", "_blank.txt"}
    read, skipped = files.read_texts(files.read_folder(spark, root))
    assert {r["path"]: r["text"] for r in read.collect()} == {n: texts[n] for n in kept - {"_big.txt", "_blank.txt"}}
    assert {r["path"] for r in skipped.collect()} == {"_big.txt", "_blank.txt"}
    assert sorted(r["path"] for r in files.read_folder(spark, root).select("path").collect()) == sorted(kept) == sorted(files.list_files(root)[0])
    assert {r["path"] for r in files.read_folder(spark, root, glob="*.{md,py}").select("path").collect()} == {n for n in kept if n.endswith(("md", "py"))}
    assert {n for n, *_ in files._hidden_remote(*_hadoop_path(spark, root))} == kept - {"a.md"}
    _, nodes, _ = Engine(spark, str(tmp_path / "home"), limits=Limits(None, None, None)).scan(root)
    assert {r["id"] for r in nodes.collect()} == kept
