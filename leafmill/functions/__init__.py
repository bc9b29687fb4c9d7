"""Part of leafmill; see the modules."""
