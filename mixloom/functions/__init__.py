"""Column expressions and the NumPy kernel that runs inside Arrow tasks."""
