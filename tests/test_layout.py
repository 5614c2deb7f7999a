"""The graph library stands without the training-data subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_it():
    for path in (ROOT / "mycelia").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_no_local_checkpoint():
    for path in [*(ROOT / "mycelia").rglob("*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint" not in path.read_text(), path
