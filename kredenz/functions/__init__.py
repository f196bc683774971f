"""Column expressions: every rule of the scalar inventory, Column in, Column out."""
