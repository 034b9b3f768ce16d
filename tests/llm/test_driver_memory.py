"""What is sent to every executor, and so is built in the driver's memory, does not grow with the corpus."""

from tessera.llm import common, jaccard


def test_jaccard_tables_are_not_broadcast_by_their_file_size(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    texts += [t + " one more" for t in texts] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, write = [], common.materialize

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(common, "materialize", seen)
    monkeypatch.setattr(jaccard, "written", seen, raising=False)
    monkeypatch.setattr(jaccard, "IDS", -1)  # nothing is small enough to be sent after its rows are counted
    found = jaccard.near_duplicates(docs)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(i, i % 20) for i in range(45)]
    assert len(plans) > 20 and any("SortMergeJoin" in p for _, p in plans)
    sent = [(name, line.strip()) for name, p in plans for line in p.splitlines() if "Broadcast" in line]
    assert sent == []
