"""Part of meshquill."""
