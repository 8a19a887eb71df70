import json

from lodestone.cli import main
from tests.test_html_facts import FEATURE, SKU, SPEC


def test_commands(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, html in {"spec_zh": SPEC + SKU, "spec_en": SPEC + SKU, "feature_en": FEATURE}.items():
        (raw / f"{name}.html").write_text(html, encoding="utf-8")
    (raw / "manifest.json").write_text('{"spec_zh": {"url": "u", "fetched_at": "2025-01-02T03:04:05+00:00", "bytes": 7, "status": 200}}')
    (tmp_path / "qa.jsonl").write_text('{"id": "a", "question": "display refresh rate", "lang": "en", "type": "fact", "gold_docs": ["fact.display"], "must_include": ["240Hz"]}\n{"id": "b", "question": "zzz", "lang": "en", "type": "negative"}\n')

    def run(*args):
        code = main(["--data", str(tmp_path), "--product", "Pro 16", *args], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    code, out, _ = run("build", "--features", "feature_en", "--no-validation")
    assert code == 0 and '"fact"' in out
    assert "cpu.cores" in run("inspect", "--facts")[1]
    assert json.loads(run("fetch", "--status")[1])["cached"] is True
    assert run("fetch")[1] == "" and json.loads(run("fetch", "--force")[1])["key"] == "spec_zh"
    assert "240Hz" in run("search", "display refresh rate", "--top-k", "2")[1]
    assert run("ask", "display refresh rate")[1] == run("ask", "display refresh rate", "--no-stream")[1]
    assert "240Hz" in run("ask", "display refresh rate")[1] and len(run("ask", "display refresh rate", "--max-tokens", "2")[1].split()) == 2
    scores = json.loads(run("--mode", "bm25", "eval-retrieval", "--questions", str(tmp_path / "qa.jsonl"), "--modes", "bm25")[1])
    assert scores[0]["recall_at_1"] == 1.0
    swept = json.loads(run("--mode", "bm25", "bench", "--questions", str(tmp_path / "qa.jsonl"), "--top-k-sweep", "1", "3", "--no-rag-control", "--repeats", "2", "--output", str(tmp_path / "o.json"))[1])
    assert all(r["repeats"] == 2 and r["answer_s_median"] > 0 for r in swept) and swept[0]["context_chars_median"] <= swept[1]["context_chars_median"]
    assert [r["keyword_accuracy"] for r in swept] == [1.0, 1.0, 0.0] and len(json.loads((tmp_path / "o.json").read_text())) == 3
    code, _, err = main(["--data", str(tmp_path / "none"), "inspect"], spark), *capsys.readouterr()
    assert code == 1 and err.startswith("error: ") and err.count("\n") == 1
