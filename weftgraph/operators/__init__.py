"""Data-parallel operators on ordered arrays, and operators for skewed, dangling and broken rows."""
