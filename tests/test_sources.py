from __future__ import annotations

import json
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from towerlens.operators import clean, columns
from towerlens.schema import RAW_SCHEMA
from towerlens.settings import Settings
from towerlens.sources import files, history, xlsx
from towerlens.streaming import ingest

HEADER = "Severity,Occurred On (NT),Alarm ID,MO Name,Name,Alarm Source,eNodeB ID"
LINE = "{sev},2024-01-01 00:{minute:02d}:00,1,MO,{name},ZBIY43_x,80001"


def test_titled_csv_finds_each_header_and_rejects_files_without(spark, tmp_path):
    good = ["Alarm Logs", "Export", "Severity of the day", "", "", HEADER]
    good += [LINE.format(sev="Major", minute=i, name='"Fault, rare"') for i in range(30)]
    (tmp_path / "a.csv").write_text("\n".join(good) + "\n")
    other = ["Name,Severity,Occurred On (ST),MO Name", "X,Minor,2024-01-01 00:00:01,M1"]
    (tmp_path / "b.csv").write_text("\n".join(other) + "\n")
    (tmp_path / "c.csv").write_text("nothing\nhere\n")
    (tmp_path / "d.csv").write_text("\n".join(["title"] * 12 + [HEADER, LINE.format(sev="Major", minute=1, name="late")]) + "\n")
    loaded = files.read_titled_csv(spark, str(tmp_path))
    rows = loaded.rows.collect()
    assert len(rows) == 31
    assert {r["name"] for r in rows} == {"Fault, rare", "X"}
    assert [r["occurred_on_st"] for r in rows if r["name"] == "X"] == ["2024-01-01 00:00:01"]
    assert sorted(r["source_file"].rsplit("/", 1)[1] for r in loaded.rejected.collect()) == ["c.csv", "d.csv"]


def test_one_folder_of_mixed_headers_titles_and_broken_files(spark, tmp_path):
    """Column orders differ from file to file, and one file of each kind is broken."""
    (tmp_path / "a.csv").write_text("Severity,Name,Alarm ID\nMajor,A,1\n,B\nMinor,C,3,spare\n")
    (tmp_path / "b.csv").write_text("Log of the day\n\nName,Alarm ID,Severity,Zone Of Mine\nD,4,Major,north\n\nLog of the day\n")
    (tmp_path / "c.csv").write_text("\ufeffname,severity\r\n\"E, e\",\"say \"\"x\"\"\"\r\n")
    (tmp_path / "bad.csv").write_bytes(b"\x00\x01 neither\nheader,nor,data\n")
    (tmp_path / "empty.csv").write_text("")
    _book(tmp_path / "d.xlsx", [["Alarm ID", "Severity", "My Column", "Name"], ["5", "Minor", "mine", "F"]])
    _book(tmp_path / "cut.xlsx", [["Severity", "Alarm ID", "Name"], *[["Major", str(i), "half"] for i in range(6_000)]], cut=True)
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    spark.createDataFrame([("G", "Major", 7)], "name string, severity string, extra int").coalesce(1).write.parquet(str(tmp_path / "p1.parquet"))
    spark.createDataFrame([("Minor", "H")], "severity string, name string").coalesce(1).write.parquet(str(tmp_path / "p2.parquet"))
    spark.createDataFrame([], "severity string, name string").coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not quite")
    loaded = files.load_folder(spark, str(tmp_path))
    got = {r["name"]: r for r in loaded.rows.collect()}
    assert {n: (r["severity"], r["alarm_id"]) for n, r in got.items()} == {
        "A": ("Major", "1"), "B": (None, None), "C": ("Minor", "3"), "D": ("Major", "4"), "E, e": ('say "x"', None),
        "F": ("Minor", "5"), "G": ("Major", None), "H": ("Minor", None)}
    assert got["D"]["zone_of_mine"] == "north" and got["F"]["my_column"] == "mine" and got["G"]["extra"] == 7
    assert loaded.rows.count() == 8
    names = sorted(r["source_file"].rsplit("/", 1)[1] for r in loaded.rejected.collect())
    assert names == ["bad.csv", "bad.parquet", "bad.xlsx", "cut.xlsx"]  # a file of no bytes has no rows either way


def test_any_number_of_headers_is_one_scan(spark, tmp_path):
    """1,200 headers that differ, more than any union of frames would plan."""
    for i in range(1_200):
        (tmp_path / f"{i}.csv").write_text(f"Severity,Name,Occurred,own {i % 40} {i}\nMajor,n{i},2024,v{i}\n".replace(f" {i % 40} {i}", f" {i % 40}" + "," * (i // 40)))
    loaded = files.read_delimited(spark, str(tmp_path))
    text = loaded.rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [value") == 1 and "Union" not in text
    rows = loaded.rows.collect()
    assert len(rows) == 1_200 and loaded.rejected.count() == 0
    assert all(r[f"own_{int(r['name'][1:]) % 40}"] == "v" + r["name"][1:] for r in rows)


def test_a_folder_of_broken_files_only(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"nothing")
    (tmp_path / "b.csv").write_text("x\n")
    loaded = files.load_folder(spark, str(tmp_path))
    assert loaded.rows.count() == 0 and loaded.rejected.count() == 2


def _book(path, rows, shared=False, styles=None, cut=False):
    cells = []
    texts = []
    for row in rows:
        line = ""
        for i, value in enumerate(row):
            ref = f'{chr(65 + i)}1'
            if isinstance(value, float):
                line += f'<c r="{ref}" s="1"><v>{value}</v></c>'
            elif value is None:
                continue
            elif shared:
                line += f'<c r="{ref}" t="s"><v>{len(texts)}</v></c>'
                texts.append(value)
            else:
                line += f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
        cells.append(f"<row>{line}</row>")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as archive:
        sheet = f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>"
        archive.writestr("xl/worksheets/sheet1.xml", sheet[:-60] if cut else sheet)
        if shared:
            items = "".join(f"<si><t>{t}</t></si>" for t in texts)
            archive.writestr("xl/sharedStrings.xml", f"<sst {ns}>{items}</sst>")
        if styles:
            archive.writestr("xl/styles.xml", f"<styleSheet {ns}><numFmts><numFmt numFmtId='164' formatCode='yyyy-mm-dd hh:mm:ss'/></numFmts>"
                             "<cellXfs><xf numFmtId='0'/><xf numFmtId='164'/></cellXfs></styleSheet>")


def test_excel_sniffs_headers_reads_dates_and_lists_bad_files(spark, tmp_path):
    names = ["Severity", "Occurred On (NT)", "Alarm ID", "Name"]
    _book(tmp_path / "a.xlsx", [["title"], [], [], [], [], names, ["Major", "2024-01-01 00:00:00", "1", "A"]])
    _book(tmp_path / "b.xlsx", [names, ["Minor", 45292.5, "2", "B"], ["Minor", None, "3", "C"]], shared=True, styles=True)
    _book(tmp_path / "none.xlsx", [["no"], ["header"]])
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    loaded = files.read_excel(spark, str(tmp_path))
    rows = {r["name"]: r for r in loaded.rows.collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["B"]["occurred_on_nt"] == "2024-01-01 12:00:00"
    assert rows["C"]["occurred_on_nt"] is None
    assert sorted(r["source_file"].rsplit("/", 1)[1] for r in loaded.rejected.collect()) == ["broken.xlsx", "none.xlsx"]
    cleaned = clean.clean_alarms(loaded.rows).collect()
    assert {r["alarm_name"] for r in cleaned} == {"A", "B"}


def test_excel_with_a_fixed_header_row(tmp_path, spark):
    _book(tmp_path / "a.xlsx", [["Kind", "Name"], ["x", "A"]])
    rows = files.read_excel(spark, str(tmp_path / "a.xlsx"), header_row=0).rows.collect()
    assert [r["name"] for r in rows] == ["A"]


def test_is_header_needs_severity_and_one_more():
    assert xlsx.is_header(["Severity", "Alarm ID"]) and xlsx.is_header(["Severity MO Name"])
    assert not xlsx.is_header(["Severity"]) and not xlsx.is_header(["Alarm ID"])


def test_columns_without_severity_and_other_time_names(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "X"), ("bad", "Y")], "`Occurred On (ST)` string, Name string")
    row = clean.clean_alarms(df).collect()
    assert len(row) == 1 and row[0]["severity"] == "Major" and row[0]["duration_minutes"] == 0.0


def _alarms(spark, times):
    df = spark.createDataFrame([(t, f"A{i}") for i, t in enumerate(times)], "event_time string, alarm_name string")
    return df.withColumns({"event_time": F.col("event_time").cast("timestamp"), "site_id": F.lit("S"),
                           "node_identifier": F.lit("N"), "severity": F.lit("Major")})


def test_history_appends_once_and_purges_strictly(spark, tmp_path):
    path = str(tmp_path / "history")
    now = datetime(2024, 3, 1, 12)
    times = ["2024-01-01 11:59:59", "2024-01-01 12:00:00", "2023-12-31 23:00:00", "2024-02-28 01:00:00"]
    assert history.append(_alarms(spark, times), path, "one", now) == 4
    assert history.append(_alarms(spark, times), path, "one", now) == 0
    assert history.append(_alarms(spark, times[:1]), path, "two", now) == 1
    assert history.append(_alarms(spark, times[:1]), path, "two", now, again=True) == 1
    purged = history.purge(spark, path, now, days=60)
    assert (purged.rows, purged.dropped_dates, purged.rewritten_date) == (4, ["2023-12-31"], "2024-01-01")
    left = sorted(r["event_time"].isoformat() for r in history.read(spark, path).collect())
    assert left == ["2024-01-01T12:00:00", "2024-02-28T01:00:00"]
    again = history.purge(spark, path, now, days=60)
    assert again.rows == 0 and history.read(spark, path).count() == 2


def test_rows_without_a_source_are_appended_once(spark, tmp_path):
    path, now = str(tmp_path / "history"), datetime(2024, 3, 1)
    rows = _alarms(spark, ["2024-02-01 00:00:00", "2024-02-02 00:00:00"]).withColumn("source_file", F.when(F.col("alarm_name") == "A0", "x"))
    assert [history.append(rows, path, None, now) for _ in range(3)] == [2, 0, 0]
    assert history.append(rows.withColumn("source_file", F.lit("y")), path, None, now) == 2
    assert history.read(spark, path).count() == 4


def test_known_sources_come_from_the_manifest_alone(spark, tmp_path):
    path, now = str(tmp_path / "history"), datetime(2024, 3, 1)
    history.append(_alarms(spark, ["2024-02-01 00:00:00"]), path, "one", now)
    entries = history.manifest(spark, path)
    assert [tuple(r)[1:] for r in entries.collect()] == [("one", date(2024, 2, 1), 1)]
    assert all("/manifest/" in f for f in entries.inputFiles())


def test_a_crash_before_the_commit_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "history"), datetime(2024, 3, 1, 12)
    rows = _alarms(spark, ["2024-01-01 11:00:00", "2024-01-01 13:00:00", "2023-12-01 00:00:00", "2024-02-01 00:00:00"])
    commit = history._commit

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(history, "_commit", dies)
    with pytest.raises(OSError):
        history.append(rows, path, "one", now)
    assert history.read(spark, path).count() == 0
    monkeypatch.setattr(history, "_commit", commit)
    assert history.append(rows, path, "one", now) == 4 and history.append(rows, path, "one", now) == 0
    monkeypatch.setattr(history, "_commit", dies)
    with pytest.raises(OSError):
        history.purge(spark, path, now, 60)
    assert history.read(spark, path).count() == 4  # not purged by halves
    monkeypatch.setattr(history, "_commit", commit)
    assert history.purge(spark, path, now, 60).rows == 2
    assert history.read(spark, path).count() == 2
    spare = history.vacuum(spark, path, datetime.now() + timedelta(hours=1))
    assert len(spare) == 3 and history.read(spark, path).count() == 2  # two lost snapshots, the purged one


def test_a_lost_race_starts_again(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "history"), datetime(2024, 3, 1)
    commit, calls = history._commit, []

    def overtaken(*args):
        if not calls:
            calls.append(1)
            monkeypatch.setattr(history, "_commit", commit)
            history.append(_alarms(spark, ["2024-02-05 00:00:00"]), path, "other", now)
        return commit(*args)

    monkeypatch.setattr(history, "_commit", overtaken)
    assert history.append(_alarms(spark, ["2024-02-01 00:00:00"]), path, "one", now) == 1
    assert sorted(r[0] for r in history.read(spark, path).select("file_source").collect()) == ["one", "other"]
    assert history.versions(spark, path) == [1, 2]


def test_history_of_an_absent_path_is_empty(spark, tmp_path):
    assert history.read(spark, str(tmp_path / "no")).count() == 0
    assert history.purge(spark, str(tmp_path / "no"), datetime(2024, 1, 1)).rows == 0


def test_history_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "history")
    history.append(_alarms(spark, ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]), path, "x", datetime(2024, 1, 3))
    plan = history.expired(history.read(spark, path), datetime(2024, 3, 2), 60)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_settings_round_trip_and_defaults(tmp_path):
    path = str(tmp_path / "settings.json")
    assert Settings.load(path) == Settings()
    chosen = Settings(active_targets=("OUTAGE_CELL_FAULT",), lookback_hours=(24, 6))
    chosen.save(path)
    assert Settings.load(path) == chosen and chosen.streak_hours == 6
    (tmp_path / "settings.json").write_text("{broken")
    assert Settings.load(path) == Settings() and Settings.load(path).problems
    (tmp_path / "settings.json").write_text(json.dumps({"ACTIVE_TARGETS": ["NOPE"]}))
    assert Settings.load(path).problems == ("unknown target NOPE",)


def test_stream_keeps_late_rows_and_drops_repeats(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    names = [f.name for f in RAW_SCHEMA.fields]

    def write(file, rows):
        lines = [",".join(names)]
        for row in rows:
            lines.append(",".join(str(row.get(n, "")) for n in names))
        (drop / file).write_text("\n".join(lines) + "\n")

    def alarm(time, number, name="RF Fault"):
        return {"occurred_on": time, "log_serial_number": number, "alarm_name": name, "alarm_source": "ZBIY43_x", "severity": "Major"}

    base = str(tmp_path)
    paths = (f"{base}/history", f"{base}/counts", f"{base}/checkpoint")
    write("1.csv", [alarm("2024-01-01 10:00:05", 1), alarm("2024-01-01 10:00:45", 2), alarm("2024-01-01 11:00:00", 3)])
    ingest.start(ingest.open_folder(spark, str(drop), RAW_SCHEMA), *paths).awaitTermination()
    write("2.csv", [alarm("2024-01-01 10:00:59", 4), alarm("2024-01-02 09:00:00", 5), alarm("2023-12-01 01:00:00", 6)])
    ingest.start(ingest.open_folder(spark, str(drop), RAW_SCHEMA), *paths).awaitTermination()
    got = {(r["entity"], r["bucket_start"].isoformat()): r["alarms"] for r in ingest.bucket_counts(spark, paths[1]).collect()}
    assert got == {
        ("ZBIY43", "2024-01-01T10:00:00"): 2, ("ZBIY43", "2024-01-02T08:00:00"): 1, ("ZBIY43", "2023-12-01T00:00:00"): 1}
    # a repeated batch replaces its own output
    batch = spark.read.option("header", True).schema(RAW_SCHEMA).csv(str(drop / "2.csv"))
    ingest.store_batch(batch, 1, paths[0], paths[1])
    assert spark.read.parquet(paths[0]).count() == 4


def test_windowed_counts_close_by_the_watermark_and_go_on_after_a_restart(spark, tmp_path):
    drop, names = tmp_path / "drop", [f.name for f in RAW_SCHEMA.fields]
    drop.mkdir()

    def write(file, times):
        rows = [{"occurred_on": t, "log_serial_number": i, "alarm_name": "RF Fault", "alarm_source": "ZBIY43_x", "severity": "Major"} for i, t in enumerate(times)]
        (drop / file).write_text("\n".join([",".join(names), *(",".join(str(r.get(n, "")) for n in names) for r in rows)]) + "\n")

    def counts():
        stream = ingest.open_folder(spark, str(drop), RAW_SCHEMA)
        ingest.start_windowed(stream, str(tmp_path / "counts"), str(tmp_path / "checkpoint")).awaitTermination()
        return {r["bucket_start"].isoformat(): r["alarms"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()}

    write("1.csv", ["2024-01-01 10:00:05", "2024-01-01 10:00:45", "2024-01-01 11:59:00", "2024-01-01 15:00:00"])
    assert counts() == {"2024-01-01T10:00:00": 2}  # one minute twice; 14:00 is still open
    # a repeat and a late row of the open window count, a row behind the watermark does not
    write("2.csv", ["2024-01-01 15:00:30", "2024-01-01 14:10:00", "2024-01-01 10:30:00", "2024-01-01 20:30:00"])
    assert counts() == {"2024-01-01T10:00:00": 2, "2024-01-01T14:00:00": 2}
    assert counts() == {"2024-01-01T10:00:00": 2, "2024-01-01T14:00:00": 2}


def test_column_operators(spark):
    df = spark.createDataFrame([("a", None, 1, 5), ("b", None, 1, None)], "x string, y string, c int, n int")
    assert columns.drop_mostly_missing(df, 0.95, keep=()).columns == ["x", "c", "n"]
    assert columns.constant_columns(df) == ["y", "c", "n"]
    assert columns.align(df, ["n", "zz"]).collect()[1].asDict() == {"n": 0.0, "zz": 0.0}
    with pytest.raises(ValueError):
        columns.name_by_position(df, ("a", "b"))
