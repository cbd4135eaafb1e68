"""Report text: reason lists, readable record blocks, prompts and completions.

Everything up to the prompt is a native projection per row (no shuffle):
reasons come from the row's attribution array, the record block from the
row's own columns.  Completions call a caller-supplied client inside
``mapInPandas`` — one client per task, one request per row, an exception per
row becomes text instead of a failed job.  Completions are not idempotent:
``complete_once`` writes them as they are made, keyed by row, and asks only for
keys without an answer.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.functions.dictionaries import (COMPLETION_ERROR_PREFIX, COMPLETION_METADATA_ERROR_PREFIX,
                                            SYSTEM_PROMPT, USER_PROMPT_TEMPLATE)
from tabrisk.functions.text import format_by_rule, map_lookup
from tabrisk.sources.io import append_with_backup, read_current


def display_value(col: str, value_labels: Mapping, rules: Mapping) -> Column:
    """Dictionary label, else unit format, else the plain string of one column."""
    if col in value_labels:
        return map_lookup(col, value_labels[col])
    if col in rules:
        return format_by_rule(col, rules[col])
    return F.col(col).cast("string")


def feature_block(df: DataFrame, columns: Sequence[str], display_names: Mapping[str, str],
                  value_labels: Mapping, rules: Mapping, name: str = "feature_block") -> DataFrame:
    """``Name: value`` lines of the mapped columns, in source column order."""
    lines = [F.concat(F.lit(f"{display_names[c]}: "), F.coalesce(display_value(c, value_labels, rules),
                                                                F.lit("nan")))
             for c in columns if c in display_names]
    return df.withColumn(name, F.concat_ws("\n", *lines))


def reason_list(top: DataFrame, key: str, display_names: Mapping[str, str],
                name: str = "reasons") -> DataFrame:
    """Display names of the top reasons joined with ``', '`` in rank order."""
    m = F.create_map(*[x for k, v in display_names.items() for x in (F.lit(k), F.lit(v))])
    shown = F.coalesce(F.try_element_at(m, F.col("feature")), F.col("feature"))
    per = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("reason_rank", shown.alias("n")))).alias("_r"))
    return per.select(key, F.array_join(F.transform("_r", lambda s: s["n"]), ", ").alias(name))


def reasons_inline(shap_col: str, features: Sequence[str], display_names: Mapping[str, str],
                   k: int = 3) -> Column:
    """The same reason text straight from a row's attribution array (no shuffle)."""
    names = F.array(*[F.lit(display_names.get(c, c)) for c in features])
    pairs = F.transform(shap_col, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    ordered = F.array_sort(F.filter(pairs, lambda s: s["v"] > 0),
                           lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1)
                           .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    return F.array_join(F.transform(F.slice(ordered, 1, k), lambda s: F.element_at(names, s["i"] + 1)), ", ")


def record_card(df: DataFrame, key: str, label: str, block: str = "feature_block", status: str = "Actual status",
                labels: tuple[str, str] = ("No Risk", "Risk"), name: str = "card") -> DataFrame:
    """Add a card: index, actual label and the record block."""
    shown = F.when(F.col(label) == 1, F.lit(labels[1])).otherwise(F.lit(labels[0]))
    lines = [F.concat(F.lit("Index: "), F.col(key).cast("string")), F.concat(F.lit(f"{status}: "), shown), F.col(block)]
    return df.withColumn(name, F.concat_ws("\n", *lines))


# Functions that run in Python workers are shipped by value, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """``concat`` of the literal pieces of ``template`` and the named columns."""
    parts, last = [], 0
    for m in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[last:m.start()]))
        parts.append(F.coalesce(values[m.group(1)].cast("string"), F.lit("")))
        last = m.end()
    parts.append(F.lit(template[last:]))
    return F.concat(*parts)


def prompts(df: DataFrame, reasons: str = "reasons", decision_label: str = "decision_label",
            block: str = "feature_block", system: str = SYSTEM_PROMPT,
            template: str = USER_PROMPT_TEMPLATE) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt`` columns."""
    user = fill_template(template, {"top_feature_list": F.col(reasons), "risk_label": F.col(decision_label),
                                    "patient_feature_block": F.col(block)})
    return df.withColumn("system_prompt", F.lit(system)).withColumn("user_prompt", user)


USAGE = T.StructType([T.StructField("prompt_tokens", T.IntegerType()),
                      T.StructField("completion_tokens", T.IntegerType()),
                      T.StructField("total_tokens", T.IntegerType())])
COMPLETION = T.StructType([T.StructField("text", T.StringType()), T.StructField("usage", USAGE),
                           T.StructField("model", T.StringType()),
                           T.StructField("finish_reason", T.StringType())])


def complete(df: DataFrame, client_factory: Callable[[], object], key: str,
             system: str = "system_prompt", user: str = "user_prompt",
             with_metadata: bool = False, max_tokens: int = 500, temperature: float = 0.0,
             seed: int = 42) -> DataFrame:
    """Call a chat client per row: ``key, completion`` (string, or the metadata struct).

    ``client_factory()`` runs inside each task and must return an object with
    ``chat(system, user, **options) -> dict(text, usage, model, finish_reason)``.
    """
    key_type = df.schema[key].dataType
    out_type = COMPLETION if with_metadata else T.StringType()
    schema = T.StructType([T.StructField(key, key_type), T.StructField("completion", out_type)])

    def run(batches):
        client = client_factory()
        for pdf in batches:
            results = []
            for s, u in zip(pdf[system], pdf[user]):
                try:
                    if with_metadata:
                        r = client.chat(s, u, max_tokens=max_tokens, temperature=temperature, seed=seed)
                        results.append({"text": r["text"], "usage": r.get("usage"),
                                        "model": r.get("model"), "finish_reason": r.get("finish_reason")})
                    else:
                        results.append(client.chat(s, u)["text"])
                except Exception as e:  # one failing row must not fail the job
                    if with_metadata:
                        results.append({"text": f"{COMPLETION_METADATA_ERROR_PREFIX}{e}", "usage": None,
                                        "model": None, "finish_reason": "error"})
                    else:
                        results.append(f"{COMPLETION_ERROR_PREFIX}{e}")
            yield pd.DataFrame({key: pdf[key], "completion": results})

    return df.select(key, system, user).mapInPandas(run, schema)


def complete_once(df: DataFrame, client_factory: Callable[[], object], key: str, path: str, chunks: int = 1,
                  system: str = "system_prompt", user: str = "user_prompt", run: str = "", **options) -> DataFrame:
    """Ask for every key that has no answer at ``path`` yet, keep the answers there
    and return all of them: ``key, completion, run``.

    The answers are an append-only table.  The keys without one are dealt to
    ``chunks`` by a hash; each chunk is asked for in a single write of its own batch,
    which a writer must have claimed, so what a chunk has answered stays when a later
    one fails and is never asked for again.  A call that raises leaves no answer: the
    next run asks again.  Two calls for one key are only possible where a task fails
    or an executor is lost before its chunk is written (calls can't be undone); more
    chunks make that stretch shorter.  ``run`` names the run in its answers.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], T.StructField("completion", COMPLETION), T.StructField("run", T.StringType())])
    failed = F.col("completion.finish_reason").eqNullSafe("error")
    for chunk in range(chunks):
        answered = read_current(spark, path, schema)
        todo = df.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == chunk).join(answered.select(key), key, "left_anti")
        answers = complete(todo, client_factory, key, system, user, with_metadata=True, **options)
        append_with_backup(answers.where(~failed).withColumn("run", F.lit(run)), path)
    return read_current(spark, path, schema)


class EchoClient:
    """Deterministic in-process client for tests: no network, no key.

    Answers with the sentence the prompt requires first, then the status line;
    token counts are whitespace word counts.
    """

    model = "echo-1"

    def chat(self, system: str, user: str, **options) -> dict:
        if "raise" in options:
            raise RuntimeError(options["raise"])
        m = re.search(r'"(The input features[^"]*)"', user)
        status = re.search(r"Predicted Stroke Status: (.*)\n\nPatient Data", user)
        text = (m.group(1) if m else "") + ("\n\nOverall Summary: " + status.group(1) if status else "")
        p, c = len((system + " " + user).split()), len(text.split())
        return {"text": text, "usage": {"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c},
                "model": self.model, "finish_reason": "stop"}
