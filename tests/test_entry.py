import re
import subprocess
import sys
import textwrap
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["page_id", "url", "method", "fp"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_does_without_the_llm_package():
    code = textwrap.dedent(
        """
        import sys

        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name in ("urlflow.llm", "corpus_pipeline") or name.startswith("urlflow.llm."):
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e

        assert "dedup_first_wins" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
        """
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_llm_package():
    for p in (REPO / "urlflow").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
