"""Part of loomcut."""
