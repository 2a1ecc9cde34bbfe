"""Part of seqlume."""
