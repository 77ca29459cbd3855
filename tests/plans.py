"""What a query actually did: its executed plan and what its scans read."""

from __future__ import annotations


def plan_text(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scan_metrics(df) -> list[dict[str, int]]:
    """Metrics of the scans of the main plan; those inside subqueries are left out."""
    df.collect()
    found = []

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            metrics = node.metrics()
            found.append({k: metrics.get(k).get().value() for k in ("numFiles", "numOutputRows")})
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def shuffled_rows(df) -> list[int]:
    """Rows written to each shuffle of the main plan, last shuffle first."""
    df.collect()
    found = []

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def files_read(df) -> dict[str, list[int]]:
    """Root folder (its last name) of each scan of the main plan, with the number of files each of them opened."""
    df.collect()
    found: dict[str, list[int]] = {}

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            root = node.relation().location().rootPaths().apply(0).getName()
            found.setdefault(root, []).append(node.metrics().get("numFiles").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found
