"""Small inputs shared by the tests."""

from __future__ import annotations

from rackpulse.schemas import TELEMETRY_RECORD

# The exporter's columns.
HEADER = "timestamp,metric_name,gpu_id,device,uuid,modelName,Hostname,container,pod,namespace,value,labels_raw"
FULL_ROW = (
    '2026-02-03T04:05:06Z,BOARD_WATTS,6,accel6,GPU-north-6,Corvid X2 96GB,node-k12,'
    'trainer,run-88,lab,317.25,"firmware=""9.4.1"",slot=""6"""'
)


def csv_line(uuid="GPU-one", value="1", metric="BOARD_WATTS", stamp="now", extra=""):
    return f"{stamp},{metric},0,accel0,{uuid},Corvid X1 48GB,host-1,,,,{value},x{extra}"


def write_csv(folder, *lines, name="part.csv"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")
    return str(folder)


def record(uuid="GPU-one", ns=1_000, metric="m", value=1.0, **other):
    row = dict.fromkeys(TELEMETRY_RECORD.names, "")
    row.update(ingested_unix_ns=ns, sample_unix_ns=ns, metric_name=metric, uuid=uuid, value=value,
               model_name="Corvid X1 48GB")
    row.update(other)
    return row


def messages(spark, rows, topic="telemetry"):
    """Log rows from (partition, offset, record or None)."""
    from rackpulse.schemas import MESSAGE_LOG

    return spark.createDataFrame(
        [
            (topic, partition, offset, None if rec is None else tuple(rec[n] for n in TELEMETRY_RECORD.names), {}, 0)
            for partition, offset, rec in rows
        ],
        MESSAGE_LOG,
    )


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_rows(df):
    """Rows that the plan's file scans hand on, after row groups were skipped."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    waiting, total = [execution.executedPlan()], 0
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            waiting.append(node.plan())
        if node.nodeName().startswith("Scan"):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children().iterator()
        while children.hasNext():
            waiting.append(children.next())
    return total
