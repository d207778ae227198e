"""Reports of an evaluation: text of a few aggregates, formatted on the driver."""

from __future__ import annotations

from ..operators.evaluation import DEPTHS

MISSING = "не рассчитывалось"


def percent(x: float | None) -> str:
    return MISSING if x is None else f"{x * 100:.1f}%"


def decimal(x: float | None) -> str:
    return MISSING if x is None else f"{x:.2f}"


def cell(x: object) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def table(head: list[str], rows: list[list[object]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


#: Fixed wording of the conclusions.
def conclusions(summary: dict, laws: dict[str, dict]) -> list[str]:
    known = {k: m["top_5_accuracy"] for k, m in laws.items() if m.get("top_5_accuracy") is not None}
    out = [f"Проверено вопросов: {summary['questions_count']}.", f"Recall@5 составляет {percent(summary['top_5_accuracy'])}, Recall@10 — {percent(summary['top_10_accuracy'])}."]
    for words, edge in (("Лучший результат по Recall@5: ", max), ("Наибольшего внимания требует: ", min)):
        if known:
            out.append(words + ", ".join(k for k, v in known.items() if v == edge(known.values())) + ".")
    wrong = summary.get("wrong_document_at_1")
    return [*out, f"Есть подмешивание результатов из других законов на первой позиции: Wrong Document@1 = {percent(wrong)}." if wrong else "Проблема подмешивания других законов на первой позиции не выявлена."]


def markdown(summary: dict, laws: dict[str, dict], types: dict[str, dict], cases: list[dict], meta: dict) -> str:
    """Metrics overall and per group, then the cases without a hit among the first five.

    A case counts as failed unless its flag is true, so out-of-scope ones are listed too.
    """
    metrics = [[f"Recall@{d}", percent(summary[f"top_{d}_accuracy"])] for d in DEPTHS] + [["MRR", f"{summary['mrr']:.4f}"], ["Mean Rank", decimal(summary["mean_rank"])], ["Document Recall@5", percent(summary["document_recall_at_5"])], ["Wrong Document@1", percent(summary["wrong_document_at_1"])]]
    group = lambda g: [[k, m["questions_count"], percent(m["top_1_accuracy"]), percent(m["top_5_accuracy"]), percent(m["top_10_accuracy"]), f"{m['mrr']:.4f}"] for k, m in sorted(g.items())]
    failed = [[c["id"], c.get("law") or "", c.get("rank") or "—"] for c in cases if c.get("hit_top_5") is not True]
    lines = ["# Отчёт о тестировании retrieval", "", *(f"- {k}: {v}" for k, v in meta.items()), "", "## Итоговые метрики", "", *table(["Метрика", "Значение"], metrics)]
    for title, g in (("## По законам", laws), ("## По типам вопросов", types)):
        lines += ["", title, "", *table(["Группа", "n", "R@1", "R@5", "R@10", "MRR"], group(g))]
    lines += ["", "## Не найдены в Top-5", "", *table(["id", "Закон", "Ранг"], failed), "", "## Выводы", "", *(f"- {x}" for x in conclusions(summary, laws))]
    return "\n".join(lines) + "\n"
