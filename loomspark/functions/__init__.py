"""Column functions: scalar, vector and angle expressions without Python at run time."""
