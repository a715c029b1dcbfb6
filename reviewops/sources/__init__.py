"""Sources, landing and row builders."""
