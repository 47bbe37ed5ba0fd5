"""Sources: family files, in-memory trees and reference tables."""
