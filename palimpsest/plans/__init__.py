"""Level plans, recaps and collections."""
