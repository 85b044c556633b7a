"""Column functions: kinematics on four-vectors and reductions over lists."""
