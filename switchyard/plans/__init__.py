"""Plan-shaping helpers (size-checked broadcasts, distributed running totals) and composed flows."""
