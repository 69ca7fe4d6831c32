"""Refresh by file streams: new files only, batches that run again replace themselves, one failure stops nothing."""

import os

from civiclake.sources.incremental import Growing, read_growing, refresh_incremental, table_path


def test_only_new_files_are_added(spark, tmp_path):
    root, inbox = str(tmp_path / "lake"), str(tmp_path / "inbox")
    good, broken = Growing("good", inbox, "id long, word string", "csv"), Growing("broken", str(tmp_path / "nowhere"), "id long")
    os.makedirs(inbox)

    def put(name, *ids):
        with open(f"{inbox}/{name}.csv", "w") as out:
            out.write("id,word\n" + "".join(f"{i},w{i}\n" for i in ids))

    def refresh():
        return {r["table_name"]: (r["status"], r["rows_added"]) for r in refresh_incremental(spark, root, [broken, good]).collect()}

    put("a", 1, 2)
    assert refresh() == {"good": ("refreshed", 2), "broken": ("error", 0)}
    assert refresh()["good"] == ("refreshed", 0)
    put("b", 3)
    put("c", 4, 5)
    assert refresh()["good"] == ("refreshed", 3)
    assert sorted(map(tuple, read_growing(spark, root, good).collect())) == [(i, f"w{i}") for i in range(1, 6)]
    assert len(os.listdir(table_path(root, "good"))) == 2
    # The commit of the last batch is lost: the next refresh runs it again and nothing counts twice.
    commits = f"{root}/good/checkpoint/commits"
    for name in os.listdir(commits):
        if name.lstrip(".").startswith("1"):
            os.remove(f"{commits}/{name}")
    assert refresh()["good"] == ("refreshed", 3)
    assert read_growing(spark, root, good).count() == 5
