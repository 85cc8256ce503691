"""The commands, from files to files."""

from eventloom.__main__ import main
from eventloom.operators import kmers
from eventloom.sources import text


def test_commands(spark, tmp_path, capsys):
    pairs = "\n".join(f"{a}{b} {50 + 20 * i + 3 * j}" for i, a in enumerate("ACGT") for j, b in enumerate("ACGT"))
    (tmp_path / "k2").write_text(pairs)
    main(["train", "3", str(tmp_path / "k2"), "2", str(tmp_path / "model"), "--chunks", "2", "--least", "1", "--most", "3"])
    model = text.read_model(spark, str(tmp_path / "model"))
    assert len(model.means) == 3 and kmers.de_bruijn(2)
    raw = ",".join(str(v) for level in (60, 90, 70, 120, 80) for v in [level, level + 1, level - 1] * 8)
    (tmp_path / "s.slow5").write_text(f"#slow5_version\t0.2.0\nr1\t0\t1\t0\t1\t4000\t120\t{raw}\n")
    main(["segment", str(tmp_path / "s.slow5"), str(tmp_path / "events"), "--height", "0.5"])
    assert text.read_events(spark, str(tmp_path / "events")).count() == 1
    main(["correct", str(tmp_path / "model"), str(tmp_path / "events"), "0.1", "0.05", str(tmp_path / "out"), "--window-size", "3"])
    assert text.read_events(spark, str(tmp_path / "out")).first()["read_id"] == "r1"
    main(["tune", str(tmp_path / "model"), str(tmp_path / "events")])
    assert "p_stay" in capsys.readouterr().out
    row = "r1\t1000\t0\t1000\t+\tc1\t5000\t100\t200\t1\t1\t60\tmt:f:2\n"
    (tmp_path / "q.paf").write_text(row + row.replace("r1", "r2"))
    (tmp_path / "t.paf").write_text(row)
    main(["label", str(tmp_path / "q.paf"), str(tmp_path / "t.paf"), "--output", str(tmp_path / "labelled")])
    said = capsys.readouterr().out
    assert "n_tp: 1" in said and "n_na: 1" in said and "median_bp_per_s: 500000.00" in said
    assert sorted(r["value"][-2:] for r in spark.read.text(str(tmp_path / "labelled")).collect()) == ["na", "tp"]
