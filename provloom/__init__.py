"""Provenance analytics on Spark: audit logs -> graphs -> sequences -> ranked matches."""
