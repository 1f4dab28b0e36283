import pytest

from redpen.operators import governance


def test_freeze_and_drift(tmp_path):
    manifest, data = tmp_path / "m.json", tmp_path / "a.m2"
    data.write_text("S a b\n")
    record = governance.SplitRecord(str(data), governance.sha256_file(data), 6, 1, 0)
    governance.freeze(manifest, "c", {"train": record, "test": record})
    with pytest.raises(governance.FrozenError):
        governance.freeze(manifest, "c", {})
    assert governance.drifts(manifest) == []
    data.write_text("S a c\n")
    assert governance.drifts(manifest, "c") == ["c/test: changed", "c/train: changed"]
    data.unlink()
    assert governance.drifts(manifest) == ["c/test: missing", "c/train: missing"] and governance.drifts(manifest, "d") == []
    with pytest.raises(KeyError, match="known: test, train"):
        governance.split_path(manifest, "c", "dev")
    with pytest.raises(governance.HeldOutSplitError):
        governance.load_split(None, manifest, "c", "test")
    with pytest.raises(governance.HeldOutSplitError):
        governance.training_split("dev")
